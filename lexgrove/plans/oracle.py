"""SQL of the queries, for an engine of its own: DuckDB on the same tables."""

from __future__ import annotations

from ..functions.text import FLAG_PATTERNS, NUMBER_WORDS, STOP_WORDS, TOKEN

WORDS = f"words_of as (select doc_id, text, regexp_extract_all(text, '{TOKEN}') as words from documents where text is not null)"


def quoted(values: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def flag(name: str, t: str = "t") -> str:
    if name in FLAG_PATTERNS:
        return f"regexp_matches({t}, '{FLAG_PATTERNS[name].replace(chr(39), chr(39) * 2)}')"
    return {
        "IS_LOWER": f"(lower({t}) = {t} and upper({t}) <> {t})",
        "IS_UPPER": f"(upper({t}) = {t} and lower({t}) <> {t})",
        "IS_STOP": f"(lower({t}) in ({quoted(STOP_WORDS)}))",
        "LIKE_NUM": f"(regexp_matches({t}, '^[+\\-~±]?(?:\\p{{Nd}}+(?:[.,]\\p{{Nd}}+)*(?:/\\p{{Nd}}+)?)$') or lower({t}) in ({quoted(NUMBER_WORDS)}))",
    }[name]


def symbols(tests: list[str], words: str = "words", t: str = "t") -> str:
    mask = " + ".join(f"{1 << k} * cast(({test}) as integer)" for k, test in enumerate(tests)) or "0"
    return f"array_to_string(list_transform({words}, lambda {t}: chr(cast(19968 + {mask} as integer))), '')"


def expression(tests: int, template: str) -> str:
    classes = ["[" + "".join(chr(19968 + m) for m in range(1 << tests) if m >> k & 1) + "]" for k in range(tests)]
    return "^(?:" + template.format(*classes, any=".") + ")"


def match_steps(name: str, tests: list[str], template: str, source: str = "words_of", suppress: bool = True) -> str:
    """CTEs that end in ``name`` (doc_id, start, end): one match from each start, then those with the end of the one before dropped."""
    keep = f"where before is null or before <> \"end\"" if suppress else ""
    return f"""{name}_sym as (select doc_id, {symbols(tests)} as s from {source}),
{name}_at as (select doc_id, s, unnest(range(length(s))) as i from {name}_sym),
{name}_raw as (select doc_id, i as start, i + length(regexp_extract(substr(s, i + 1), '{expression(len(tests), template)}')) as "end" from {name}_at),
{name}_lag as (select doc_id, start, "end", lag("end") over (partition by doc_id order by start) as before from {name}_raw where "end" > start),
{name} as (select doc_id, cast(start as integer) as start, cast("end" as integer) as "end" from {name}_lag {keep})"""


def match(tests: list[str], template: str, suppress: bool = True) -> str:
    return f'with {WORDS},\n{match_steps("m", tests, template, suppress=suppress)}\nselect doc_id, start, "end" from m'
