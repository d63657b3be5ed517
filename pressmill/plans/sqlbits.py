"""SQL text used by several checking queries."""

from __future__ import annotations

SYN = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#.*)?$"


def piece(u: str, n: int) -> str:
    return f"regexp_extract({u}, '{SYN}', {n})"


def vis(c: str) -> str:
    out = f"regexp_replace({c}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "noscript"):
        out = f"regexp_replace({out}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    return out


def unesc(c: str) -> str:
    for name, char in (("middot", "·"), ("copy", "©"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("amp", "&")):
        c = f"regexp_replace({c}, '&{name};?', '{char}', 'g')"
    return c


def squash(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def text_of(c: str) -> str:
    tags = f"regexp_replace({vis(c)}, '<[^>]+>', ' ', 'g')"
    return squash(unesc(tags))


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"


def _pairs(q: str, drop: str, sort: bool) -> str:
    items = f"list_filter(string_split({q}, '&'), lambda x: x <> '')"
    dec = "url_decode(replace({0}, '+', ' '))"
    key, val = dec.format("regexp_extract(x, '^[^=]*')"), dec.format("regexp_replace(x, '^[^=]*=?', '')")
    rows = f"list_transform({items}, lambda x: {{'k': {key}, 'v': {val}}})"
    rows = f"list_filter({rows}, lambda p: NOT (starts_with(lower(p.k), 'utm_') OR lower(p.k) IN ({drop})))"
    if sort:
        rows = f"list_sort({rows})"
    enc = "replace(url_encode({0}), '%20', '+')"
    return f"array_to_string(list_transform({rows}, lambda p: {enc.format('p.k')} || '=' || {enc.format('p.v')}), '&')"


def _q(expr: str) -> str:
    return f"CASE WHEN {expr} <> '' THEN '?' || {expr} ELSE '' END"


def canon_alert(u: str) -> str:
    q = _pairs(piece(u, 4), "'fbclid','gclid'", True)
    net = f"regexp_replace(lower({piece(u, 2)}), CASE WHEN lower({piece(u, 1)}) = 'http' THEN ':80$' ELSE ':443$' END, '')"
    return f"(lower({piece(u, 1)}) || '://' || {net} || rtrim({piece(u, 3)}, '/') || {_q(q)})"


def canon_feed(u: str) -> str:
    q = _pairs(piece(u, 4), "'fbclid','gclid','mc_eid'", False)
    whole = f"(lower({piece(u, 1)}) || '://' || lower({piece(u, 2)}) || {piece(u, 3)} || {_q(q)})"
    return f"CASE WHEN {piece(u, 3)} <> '/' THEN regexp_replace({whole}, '/$', '') ELSE {whole} END"


def canon_page(u: str) -> str:
    drop = "'fbclid','gclid','yclid','igshid','mc_cid','mc_eid','ref','ref_src','amp'"
    key = "lower(regexp_extract(x, '^[^=]*'))"
    q = (f"array_to_string(list_filter(string_split({piece(u, 4)}, '&'), lambda x: x <> '' AND NOT (starts_with({key}, 'utm_') OR {key} IN ({drop}))), '&')")
    raw = f"coalesce(nullif(regexp_replace({piece(u, 3)}, '/amp$', ''), ''), '/')"
    path = f"CASE WHEN {raw} = '/' THEN '/' ELSE rtrim({raw}, '/') END"
    return f"(lower({piece(u, 1)}) || '://' || regexp_replace(lower({piece(u, 2)}), '^www\\.', '') || {path} || {_q(q)})"


def domain(u: str) -> str:
    return f"regexp_replace(lower({piece(u, 2)}), '^www\\.', '')"


def hrefs(html: str) -> str:
    tags = f"regexp_extract_all({vis(html)}, '(?is)<a\\s[^>]*>', 0)"
    vals = f"list_transform({tags}, lambda a: trim(replace(regexp_extract(a, '(?is)\\shref\\s*=\\s*\"([^\"]*)\"', 1), '&amp;', '&')))"
    return f"list_filter({vals}, lambda v: v <> '')"


def rooted(base: str, href: str) -> str:
    return (f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]') THEN {href} "
            f"ELSE {piece(base, 1)} || '://' || {piece(base, 2)} || CASE WHEN starts_with({href}, '/') THEN '' ELSE '/' END || {href} END")


MEDIA = r"(?i)\.(pdf|jpg|jpeg|png|gif|webp|svg|mp4|mp3|zip)$"
HINT = r"(?i)(\d{4}/\d{1,2}/\d{1,2}|/news/|/press/|/article/|/post/|/blog/|/story/|/report/|/analysis/|/politic|/econom|/local/)"


def has_any(col: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({col}, '{w}')" for w in words) + ")"


def first_label(col: str, labels: dict[str, list[str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {has_any(col, keys)} THEN '{label}'" for label, keys in labels.items()) + f" ELSE '{default}' END"
