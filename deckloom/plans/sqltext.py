"""Pieces of DuckDB SQL that the oracles share. Each function returns the SQL of an expression."""

from __future__ import annotations


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


def listed(values) -> str:
    return f"[{quoted(dict.fromkeys(values))}]"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sentences(x: str) -> str:
    return rf"list_filter(list_transform(string_split(regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda q: trim(q)), lambda q: q <> '')"


def tokens(x: str) -> str:
    return rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda q: q <> '')"


def words(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[a-z][a-z\-'']+')"


def content(x: str) -> str:
    from deckloom.functions.text import STOP

    return f"list_filter({words(x)}, lambda q: NOT list_contains({listed(STOP)}, q) AND length(q) > 2)"


def retrieval(x: str) -> str:
    from deckloom.functions.text import RETRIEVAL_STOP

    return rf"list_filter(regexp_extract_all(lower({x}), '[a-z0-9][a-z0-9\-'']+'), lambda q: NOT list_contains({listed(RETRIEVAL_STOP)}, q) AND length(q) > 1)"


def jaccard(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"


def normalised(x: str) -> str:
    return f"regexp_replace(lower({x}), '[^a-z0-9 ]', '', 'g')"


def idf(x: str) -> str:
    from deckloom.functions.text import COMMON

    base = f"CASE WHEN list_contains({listed(COMMON)}, {x}) THEN 0.5 WHEN length({x}) <= 4 THEN 1.0 WHEN length({x}) <= 7 THEN 1.6 WHEN length({x}) <= 11 THEN 2.2 ELSE 2.8 END"
    return f"least(3.0, greatest(0.4, {base} + CASE WHEN contains({x}, '-') THEN 0.3 ELSE 0.0 END))::DOUBLE"


def syllables(x: str) -> str:
    plain = f"regexp_replace(lower({x}), '[^a-z]', '', 'g')"
    groups = f"len(regexp_extract_all({plain}, '[aeiouy]+'))"
    silent = f"(suffix({plain}, 'e') AND {groups} > 1 AND NOT suffix({plain}, 'le') AND NOT suffix({plain}, 'ee'))"
    return f"CASE WHEN {plain} = '' THEN 0 ELSE greatest(1, {groups} - CASE WHEN {silent} THEN 1 ELSE 0 END) END"


#: Lines with text as slides: doc_id, slide_no, body, sents, title, bullets.
SLIDES = f"""
lines AS (SELECT doc_id, trim(l) AS body, i FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l,
  generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents) WHERE trim(l) <> ''),
slides AS (SELECT doc_id, slide_no, body, sents, sents[1] AS title, sents[2:] AS bullets FROM
  (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS slide_no, body, {sentences('body')} AS sents FROM lines))"""

#: One row a sentence.
PASSAGES = f"""{SLIDES},
passages AS (SELECT doc_id, slide_no, title, unnest(sents) AS sent, generate_subscripts(sents, 1)::BIGINT AS sent_no FROM slides)"""
