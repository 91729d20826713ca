"""SQL building blocks of the oracles: md5 draws, options and clock text."""

from __future__ import annotations


def mmss(x: str) -> str:
    return f"printf('%02d:%02d', CAST(floor(({x}) / 60) AS BIGINT), CAST(floor(({x}) % 60) AS BIGINT))"


def range_text(a: str, b: str) -> str:
    return f"'[' || {mmss(a)} || ' - ' || {mmss(b)} || ']'"


def clock_short(x: str) -> str:
    whole = f"CAST(round_even({x}, 0) AS BIGINT)"
    full = f"printf('%02d:%02d:%02d', {whole} // 3600, ({whole} % 3600) // 60, {whole} % 60)"
    return f"CASE WHEN {full} LIKE '00:%' THEN substr({full}, 4) ELSE {full} END"


def digest(seed: str, *parts: str) -> str:
    return f"md5(concat_ws('|', '{seed}', {', '.join(f'CAST({p} AS VARCHAR)' for p in parts)}))"


def hash60(seed: str, *parts: str) -> str:
    return f"CAST('0x' || substr({digest(seed, *parts)}, 1, 15) AS BIGINT)"


def pool(source: str, seed: str, name: str = "object") -> str:
    h = digest(seed, "session_id", name)
    return f"""SELECT session_id, {name}, row_number() OVER (PARTITION BY session_id ORDER BY {h}, {name}) - 1 AS "rank",
      count(*) OVER (PARTITION BY session_id) AS n_pool FROM (SELECT DISTINCT session_id, {name} FROM {source})"""


def drawn(items: str, pool_cte: str, k: int | str, seed: str, banned: str, ids: list[str], keep: bool = False) -> str:
    """Per item the list ``drawn``; ``banned`` is an expression over alias ``i``."""
    begin = hash60(seed, *["i." + c for c in ids])
    each = hash60(seed, *["i." + c for c in ids], "st")
    key = ", ".join(f"i.{c}" for c in ids)
    need = f"({k} + len({banned}))"
    sizes = f"(SELECT session_id, max(n_pool) AS n FROM {pool_cte} GROUP BY 1)"
    inner = f"""SELECT {key}, list(p.object ORDER BY st) AS found FROM (
        SELECT i.*, unnest(range(1, len(ranks) + 1)) AS st, unnest(ranks) AS rk FROM (
          SELECT i.*, list_filter(raw, lambda x, at_: list_position(raw, x) = at_)[1:least(n, {need})] AS ranks FROM (
            SELECT i.*, s.n, list_concat(list_transform(range(0, 2 * {need}), lambda st: {each} % s.n),
              list_transform(range(0, 3 * {need}), lambda st: ({begin} % s.n + st) % s.n)) AS raw
            FROM {items} i JOIN {sizes} s USING (session_id)) i) i) i
      JOIN {pool_cte} p ON p.session_id = i.session_id AND p."rank" = rk
      WHERE NOT list_contains({banned}, p.object) GROUP BY {key}"""
    join = "LEFT JOIN" if keep else "JOIN"
    on = " AND ".join(f"d.{c} = i.{c}" for c in ids)
    got = f"coalesce(d.found[1:{k}], [])" if keep else f"d.found[1:{k}]"
    return f"SELECT i.*, {got} AS drawn FROM {items} i {join} ({inner}) d ON {on}"


def md5_order(names: str, seed: str, *parts: str) -> str:
    ids = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    prefix = f"'{seed}', {ids}" if parts else f"'{seed}'"
    tagged = f"list_transform({names}, lambda x: md5(concat_ws('|', {prefix}, x)) || x)"
    return f"list_transform(list_sort({tagged}), lambda y: substr(y, 33))"


def options(mixed: str) -> str:
    return f"list_transform({mixed}, lambda o, i: chr(CAST(64 + i AS INTEGER)) || '. ' || o)"


def answer(mixed: str, truth: str) -> str:
    return f"chr(CAST(64 + list_position({mixed}, {truth}) AS INTEGER))"


def draw_ranks(size: str, k: int, seed: str, *parts: str) -> list[str]:
    """Expressions of ``k`` (2 or 3) distinct ranks."""
    r0 = f"({hash60(seed + '0', *parts)} % ({size}))"
    h1 = f"({hash60(seed + '1', *parts)} % nullif(({size}) - 1, 0))"
    r1 = f"({h1} + CASE WHEN {h1} >= {r0} THEN 1 ELSE 0 END)"
    if k == 2:
        return [r0, r1]
    h2 = f"({hash60(seed + '2', *parts)} % nullif(({size}) - 2, 0))"
    lo, hi = f"least({r0}, {r1})", f"greatest({r0}, {r1})"
    s2 = f"({h2} + CASE WHEN {h2} >= {lo} THEN 1 ELSE 0 END)"
    r2 = f"({s2} + CASE WHEN {s2} >= {hi} THEN 1 ELSE 0 END)"
    return [r0, r1, r2]
