"""DuckDB SQL equivalent to the engine's expressions, built from the same declarations."""

from __future__ import annotations

from veilstream.functions.spans import AROUND
from veilstream.operators import detectors as D
from veilstream.operators import risk as R
from veilstream.operators.policy import CATEGORY_ACTION
from veilstream.operators.rules import ACTIONS

_CODES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _digit(s: str, at: str) -> str:
    return f"CAST(substr({s}, {at}, 1) AS INT)"


def _code(s: str, at: str) -> str:
    return f"(strpos('{_CODES}', substr({s}, {at}, 1)) - 1)"


def check(name: str, s: str) -> str:
    d = f"regexp_replace({s}, '[^0-9]', '', 'g')"
    if name == "luhn":
        twice = f"2 * {_digit(d, f'length({d}) - i')}"
        return f"list_sum(list_transform(range(0, length({d})), lambda i: CASE WHEN i % 2 = 0 THEN {_digit(d, f'length({d}) - i')} ELSE {twice} - CASE WHEN {twice} > 9 THEN 9 ELSE 0 END END)) % 10 = 0"
    if name == "routing_number":
        return f"list_sum(list_transform(range(0, length({s})), lambda i: {_digit(s, 'i + 1')} * CASE i % 3 WHEN 0 THEN 3 WHEN 1 THEN 7 ELSE 1 END)) % 10 = 0"
    if name == "mod97":
        moved = f"(substr(upper({s}), 5) || substr(upper({s}), 1, 4))"
        step = f"(r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97"
        return f"length({s}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length({s}) + 1), lambda i: CAST({_code(moved, 'i')} AS BIGINT))), lambda r, v: {step}) = 1"
    if name == "verhoeff":
        rows = "[" + ", ".join(str(r) for r in D.checks.verhoeff_rows()) + "]"
        values = f"list_transform(range(0, 12), lambda i: CAST({rows}[i % 8 + 1][{_digit(d, '12 - i')} + 1] AS BIGINT))"
        step = "((CASE WHEN a < 5 THEN a + b ELSE a - b + 10 END) % 5 + CASE WHEN (a < 5) = (b < 5) THEN 0 ELSE 5 END)"
        return f"length({d}) >= 12 AND list_reduce(list_prepend(CAST(0 AS BIGINT), {values}), lambda a, b: {step}) = 0"
    if name == "gst_number":
        v = f"{_code(s, 'i + 1')} * (1 + i % 2)"
        return f"length({s}) = 15 AND {_code(s, '15')} = (36 - list_sum(list_transform(range(0, 14), lambda i: CAST(floor({v} / 36) AS BIGINT) + {v} % 36)) % 36) % 36"
    if name == "mrz":
        line = f"regexp_extract({s}, '[^\\n]*$')"
        value = lambda at: f"(CASE WHEN substr({line}, {at}, 1) = '<' THEN 0 ELSE {_code(line, at)} END)"
        weighted = lambda first, n: f"list_sum(list_transform(range(0, {n}), lambda i: {value(f'{first} + i')} * CASE i % 3 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 1 END))"
        return " AND ".join(f"CAST({weighted(first, n)} % 10 AS VARCHAR) = substr({line}, {first + n}, 1)" for first, n in ((1, 9), (14, 6), (22, 6)))
    raise ValueError(name)


def _around(around: int) -> str:
    """What stands near match number pos: gaps and matches in turn, cut to so many characters on either side."""
    before = "array_to_string(list_transform(range(1, pos + 1), lambda k: gaps[k] || CASE WHEN k < pos THEN hits[k] ELSE '' END), '')"
    after = "array_to_string(list_transform(range(pos + 1, len(gaps) + 1), lambda k: gaps[k] || CASE WHEN k < len(gaps) THEN hits[k] ELSE '' END), '')"
    return f"lower(right({before}, {around}) || snippet || left({after}, {around}))"


def findings(relation: str, detectors: list[D.Detector], key: str = "doc_id") -> str:
    """Findings of detectors over ASCII texts: key, det, pos and the finding."""
    parts = []
    for n, d in enumerate(detectors):
        where = ["true"]
        if d.check is not None:
            where.append(check(d.check.__name__, "snippet"))
        near = "(" + " OR ".join(f"contains(around, {text(w)})" for w in d.near) + ")" if d.near else "false"
        if d.near and d.near_required:
            where.append(near)
        severity = f"CASE WHEN {near} THEN 'HIGH' ELSE 'MEDIUM' END" if d.near else text(d.severity)
        name = f"CASE WHEN starts_with(snippet, 'ASIA') THEN 'AWS_ACCESS_KEY_TEMPORARY' ELSE '{d.name}' END" if d.name == "AWS_ACCESS_KEY" else text(d.name)
        found = f"regexp_extract_all(text, {text(d.pattern)})"
        if d.first_only:
            found = f"{found}[1:1]"
        mask = "CAST(NULL AS VARCHAR)" if d.replacement is None else text(d.replacement)
        inner = f"SELECT {key}, unnest({found}) AS snippet, generate_subscripts({found}, 1) AS pos FROM {relation}"
        if d.near:
            cut = f"SELECT {key}, {found} AS hits, string_split_regex(text, {text(d.pattern)}) AS gaps FROM {relation}"
            each = f"SELECT *, unnest(hits) AS snippet, generate_subscripts(hits, 1) AS pos FROM ({cut})"
            inner = f"SELECT {key}, snippet, pos, {_around(AROUND)} AS around FROM ({each})"
        parts.append(f"SELECT {key}, {n} AS det, pos, {text(d.category)} AS category, {name} AS match_name, snippet, {severity} AS severity, {mask} AS redacted_replacement FROM ({inner}) WHERE {' AND '.join(where)}")
    return " UNION ALL ".join(parts)


def masked(original: str, rows: str) -> str:
    """original with snippets replaced; rows: a list of snippet, chr(2), replacement in order."""
    return f"list_reduce(list_prepend({original}, {rows}), lambda t, f: replace(t, split_part(f, chr(2), 1), split_part(f, chr(2), 2)))"


def _case(x: str, values: dict, other) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {text(k)} THEN {v}" for k, v in values.items()) + f" ELSE {other} END"


def points(category: str, severity: str, nth: str) -> str:
    return f"CAST(round({_case(category, R.CATEGORY_WEIGHT, R.OTHER_WEIGHT)} * CAST({_case(f'upper({severity})', R.SEVERITY_FACTOR, R.OTHER_FACTOR)} AS DOUBLE) / (1 + CAST({R.DECAY} AS DOUBLE) * {nth})) AS INT)"


def band(total: str) -> str:
    return "CASE " + " ".join(f"WHEN {total} <= {n} THEN '{b}'" for n, b in R.BANDS) + " ELSE 'Critical' END"


def action_rank(action: str) -> str:
    return _case(action, {a: i for i, a in enumerate(ACTIONS)}, -1)


def rank_action(rank: str) -> str:
    return f"CASE {rank} " + " ".join(f"WHEN {i} THEN '{a}'" for i, a in enumerate(ACTIONS)) + " END"


def category_action(category: str) -> str:
    return _case(category, {k: text(v) for k, v in CATEGORY_ACTION.items()}, "'Allow'")
