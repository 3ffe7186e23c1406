"""Chat formatting with minimum-cost role repair.

A legal conversation is accepted by an automaton: at most one system turn, first; then user and
assistant turns in alternation, starting with the user. Dynamic programming over the automaton's
states finds the cheapest way to make a conversation legal by merging a turn into the one before it,
relabelling its role, or inserting empty turns before it; the repaired sequence is then rendered.

A turn maps costs of states to costs of states, a small min-plus matrix for each role, and matrices
of runs of turns multiply. So a conversation need not be in one task: rows are sorted by range over
(conversation, turn), each partition multiplies its runs' matrices, the runs that cross partitions
(at most two for each partition) get their entry and exit states, and every partition then settles its
own runs. ``repair`` gives each turn's decision and its fragment of the rendered text; ``render`` gives
the rendered conversations, one row each, but for those longer than ``part_chars``, which are cut into
parts of so many characters, so that no row grows with a conversation. Pieces of parts that cross
partitions, at most two for each partition, are put together by a shuffle of their own.

Defined cases: roles are read in any case and by common aliases; null and unknown roles must be
relabelled; null texts are empty; a null conversation is one like any other; null turns come first;
equal turns are ordered by role, then text; repeated rows are turns; an empty table gives no rows; of
equally cheap repairs that with the least states, from the last turn backwards, is taken;
template marks within a text are broken by a space; columns other than the four named are not read.
"""

from __future__ import annotations

from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm._common import arrow_type, materialise, read

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 1, 2, 3
FAR = 1 << 60
#: Rows in a batch of the result.
AT_ONCE = 4096
#: Turns in a partition, about; Python holds one conversation's of them at a time.
ROWS_PER_PARTITION = 1 << 17
#: Characters in a part of a rendered conversation; and about those in a batch.
PART_CHARS = 1 << 20
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"

Step = tuple[int, tuple[int, ...], bool]  # cost, states of inserted turns, whether the turn is merged


def role_of(name: str | None) -> int:
    """The state of a role's name; START stands for an unknown one."""
    return ALIASES.get((name or "").strip().lower(), START)


def steps(role: int) -> list[list[Step | None]]:
    """The cheapest step from each state to each state over a turn of this role."""
    table: list[list[Step | None]] = [[None] * 4 for _ in range(4)]
    for state, target in product(range(4), (SYSTEM, USER, ASSISTANT)):
        changed = RELABEL * (target != role)
        found: list[Step] = [(changed + MERGE, (), True)] if state == target else []
        for n in range(3):
            for chain in product((SYSTEM, USER, ASSISTANT), repeat=n):
                path = (state, *chain, target)
                if all(b in LEGAL[a] for a, b in zip(path, path[1:], strict=False)):
                    found.append((changed + INSERT * n, chain, False))
        table[state][target] = min(found, default=None, key=lambda s: (s[0], len(s[1]), s[1]))
    return table


STEPS = [steps(r) for r in range(4)]


def times(costs: list[int], role: int) -> list[int]:
    """Costs of the states after a turn."""
    out = [FAR] * 4
    for a, row in enumerate(STEPS[role]):
        if costs[a] < FAR:
            for b, s in enumerate(row):
                if s is not None and costs[a] + s[0] < out[b]:
                    out[b] = costs[a] + s[0]
    return out


def matrix(roles: list[int]) -> list[list[int]]:
    """Costs from each state to each state over a run of turns."""
    rows = []
    for a in range(4):
        costs = [FAR] * 4
        costs[a] = 0
        for r in roles:
            costs = times(costs, r)
        rows.append(costs)
    return rows


def settle(roles: list[int], start: int = START, end: int | None = None) -> list[tuple[int, Step]]:
    """(state, step) of each turn on the cheapest path from ``start``, to ``end`` if given; the least state of equal ones."""
    table = [[FAR] * 4]
    table[0][start] = 0
    for r in roles:
        table.append(times(table[-1], r))
    state = min(range(4), key=lambda s: (table[-1][s], s)) if end is None else end
    out = []
    for i in range(len(roles) - 1, -1, -1):
        _, before = min((table[i][a] + s[0], a) for a in range(4) if (s := STEPS[roles[i]][a][state]) is not None and table[i][a] < FAR)
        out.append((state, STEPS[roles[i]][before][state]))
        state = before
    return out[::-1]


def chain_states(runs: list[list[list[int]]]) -> list[tuple[int, int]]:
    """(entry, exit) states of consecutive runs, given by their matrices, on a cheapest path from START."""
    table = [[FAR] * 4]
    table[0][START] = 0
    for m in runs:
        table.append([min(min(table[-1][a] + m[a][b] for a in range(4)), FAR) for b in range(4)])
    state = min(range(4), key=lambda s: (table[-1][s], s))
    out = []
    for i in range(len(runs) - 1, -1, -1):
        before = min(range(4), key=lambda a: (table[i][a] + runs[i][a][state], a))
        out.append((before, state))
        state = before
    return out[::-1]


def fragment(text: str | None, state: int, step: Step, first: bool, last: bool) -> str:
    """What the turn adds to the rendered text."""
    body = (text or "").replace("<|im_", "< |im_")
    if step[2]:
        out = "\n" + body
    else:
        out = CLOSE * (not first) + "".join(OPEN + ROLES[s] + MIDDLE + CLOSE for s in step[1]) + OPEN + ROLES[state] + MIDDLE + body
    return out + CLOSE * last


def repair(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per turn: conversation, turn, ``role``, ``new_role``, ``merged``, ``inserted`` (roles of empty turns before it), ``cost``, ``fragment``."""
    rows = _sorted(turns, conv, turn, role, text)
    out = T.StructType([T.StructField(conv, rows.schema["conv"].dataType), T.StructField(turn, rows.schema["turn"].dataType), T.StructField("role", T.StringType()), T.StructField("new_role", T.StringType()), T.StructField("merged", T.BooleanType()), T.StructField("inserted", T.ArrayType(T.StringType())), T.StructField("cost", T.IntegerType()), T.StructField("fragment", T.StringType())])
    return _settled(rows, out, lambda at, run: ((c, t, r, ROLES[state], step[2], [ROLES[s] for s in step[1]], step[0], part) for (c, t, r, _), state, step, part in run), _crossing(rows))


def render(turns: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """Per conversation, and part of it if it is long: the conversation, ``part`` (from 0), ``n_turns`` whose text begins
    there, ``cost`` of their repair, and ``text``, of ``part_chars`` characters but in the last part."""
    rows = _sorted(turns, conv, turn, role, text)
    crossing = _crossing(rows)
    place = [T.StructField("at", T.IntegerType()), T.StructField("run", T.IntegerType())]
    sizes = _settled(rows, T.StructType([*place, T.StructField("chars", T.LongType())]), lambda at, run: [(*at, sum(len(x[3]) for x in run))], crossing, True).collect() if crossing else []
    before, total = {}, 0
    for r in sorted(sizes):
        before[r["at"], r["run"]] = total = 0 if crossing[r["at"], r["run"]][2] else total
        total += r["chars"]
    out = T.StructType([T.StructField(conv, rows.schema["conv"].dataType), T.StructField("part", T.LongType()), *place, T.StructField("n_turns", T.LongType()), T.StructField("cost", T.LongType()), T.StructField("text", T.StringType())])

    def pieces(at: tuple[int, int], run):
        chars = before.get(at, 0)
        part, n, cost, held, own = chars // part_chars, 0, 0, [], None
        for (own, *_), _, step, fresh in run:
            if chars == (part + 1) * part_chars:
                yield own, part, *at, n, cost, "".join(held)
                part, n, cost, held = part + 1, 0, 0, []
            n, cost = n + 1, cost + step[0]
            while (room := (part + 1) * part_chars - chars) < len(fresh):
                yield own, part, *at, n, cost, "".join([*held, fresh[:room]])
                part, n, cost, held, chars, fresh = part + 1, 0, 0, [], chars + room, fresh[room:]
            held.append(fresh)
            chars += len(fresh)
        yield own, part, *at, n, cost, "".join(held)

    whole = _settled(rows, out, pieces, crossing, False).drop("at", "run")
    if not crossing:
        return whole
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "run", "text"))), lambda x: x["text"]), "")
    crossed = _settled(rows, out, pieces, crossing, True).groupBy(conv, "part").agg(F.sum("n_turns").alias("n_turns"), F.sum("cost").alias("cost"), joined.alias("text"))
    return whole.unionByName(crossed)


def _sorted(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """The turns (conv, turn, role, text) in order, in partitions of bounded size, written."""
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"), F.monotonically_increasing_id().alias("own"))
    order = ["conv", "turn", "role", "text", "own"]
    n = max(int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")), turns.count() // ROWS_PER_PARTITION)
    return materialise(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("own"))


def _settled(rows: DataFrame, out: T.StructType, told, crossing: dict, only: bool | None = None) -> DataFrame:
    """Rows ``out`` that ``told`` makes of each run: its (partition, run) and its (row, state, step, fragment). ``only``:
    those that cross partitions, or those that don't."""

    def run(batches):
        from pyspark import TaskContext

        part, types = TaskContext.get().partitionId(), arrow_type(out)
        columns: list[list] = [[] for _ in out.fields]
        size = 0
        flushed = lambda: pa.RecordBatch.from_arrays([pa.array(c, types.field(i).type) for i, c in enumerate(columns)], schema=types)
        for k, (_, held) in enumerate(_runs(batches)):
            if only is not None and only is not ((part, k) in crossing):
                continue
            start, end, first, last = crossing.get((part, k)) or (START, None, True, True)
            path = settle([role_of(r) for _, _, r, _ in held], start, end)
            own = ((row, state, step, fragment(row[3], state, step, first and i == 0, last and i == len(held) - 1)) for i, (row, (state, step)) in enumerate(zip(held, path, strict=True)))
            for values in told((part, k), own):
                for column, v in zip(columns, values, strict=True):
                    column.append(v)
                size += len(values[-1]) if isinstance(values[-1], str) else 0
                if len(columns[0]) >= AT_ONCE or size >= PART_CHARS:
                    yield flushed()
                    columns, size = [[] for _ in out.fields], 0
        if columns[0]:
            yield flushed()

    return rows.mapInArrow(run, out)


def _runs(batches):
    """(whether it is the partition's last, rows) of each conversation's run of rows."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text")), strict=True):
            if held and held[-1][0] != row[0]:
                yield False, held
                held = []
            held.append(row)
    if held:
        yield True, held


def _crossing(rows: DataFrame) -> dict[tuple[int, int], tuple[int, int, bool, bool]]:
    """Of conversations that lie in several partitions: (partition, run) -> entry, exit, is first, is last.

    What comes to the driver is the first and last run of each partition, so its size is bounded by
    their number.
    """
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("run", T.IntegerType()), T.StructField("conv", rows.schema["conv"].dataType), T.StructField("costs", T.ArrayType(T.LongType()))])

    def ends(batches):
        from pyspark import TaskContext

        part, types = TaskContext.get().partitionId(), arrow_type(schema)
        edge = lambda k, held: pa.RecordBatch.from_arrays([pa.array(v, types.field(i).type) for i, v in enumerate(([part], [k], [held[0][0]], [[c for row in matrix([role_of(x[2]) for x in held]) for c in row]]))], schema=types)
        for k, (last, held) in enumerate(_runs(batches)):
            if k == 0 or last:
                yield edge(k, held)

    found = sorted(rows.mapInArrow(ends, schema).collect(), key=lambda r: (r["part"], r["run"]))
    out, group = {}, []
    for r in [*found, None]:
        if group and (r is None or r["conv"] != group[-1]["conv"]):
            if len(group) > 1:
                states = chain_states([[list(g["costs"][4 * a : 4 * a + 4]) for a in range(4)] for g in group])
                for i, (g, (a, b)) in enumerate(zip(group, states, strict=True)):
                    out[g["part"], g["run"]] = (a, b, i == 0, i == len(group) - 1)
            group = []
        if r is not None:
            group.append(r)
    return out


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(read(spark, sf_dir, "conversations"))


def _oracle() -> str:
    """SQL for conversations of one part: the same dynamic programming, forwards over costs and back over states."""
    far = 1 << 40
    listed = lambda make: "[" + ", ".join("[" + ", ".join("[" + ", ".join(make(STEPS[r][a][b]) for b in range(4)) + "]" for a in range(4)) + "]" for r in range(4)) + "]"
    text = lambda t: "'" + t.replace("\n", "' || chr(10) || '") + "'"
    empties = lambda step: text("".join(OPEN + ROLES[x] + MIDDLE + CLOSE for x in step[1]) if step else "")
    least = ", ".join("least(" + ", ".join(f"c[{a + 1}] + m[r + 1][{a + 1}][{b + 1}]" for a in range(4)) + ")" for b in range(4))
    roles = " ".join(f"WHEN '{name}' THEN {state}" for name, state in ALIASES.items())
    return f"""
WITH RECURSIVE k AS (SELECT {listed(lambda x: str(x[0] if x else far))} AS m, {listed(empties)} AS e, {listed(lambda x: str(bool(x and x[2])).lower())} AS g),
t AS MATERIALIZED (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
         CASE lower(trim(coalesce(role, ''))) {roles} ELSE {START} END AS r, replace(coalesce(text, ''), '<|im_', '< |im_') AS x
  FROM conversations),
f AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, [CAST(0 AS BIGINT), {far}, {far}, {far}] AS c FROM t
  UNION ALL SELECT t.conv_id, t.i, [{least}] FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i + 1, k),
b AS (
  SELECT f.conv_id, f.i, CAST(list_position(c, list_min(c)) - 1 AS BIGINT) AS s, CAST(NULL AS BIGINT) AS a, list_min(c) AS cost FROM f JOIN t ON t.conv_id IS NOT DISTINCT FROM f.conv_id AND t.i = f.i AND t.i = t.n
  UNION ALL
  SELECT conv_id, i, list_position(v, list_min(v)) - 1, s, cost FROM (
    SELECT b.conv_id, f.i, b.s, b.cost, list_transform([1, 2, 3, 4], lambda a: f.c[a] + m[t.r + 1][a][b.s + 1]) AS v
    FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND t.i = b.i JOIN f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1, k)),
p AS (
  SELECT t.*, b.s AS before, b.a AS state, b.cost FROM t JOIN b ON b.conv_id IS NOT DISTINCT FROM t.conv_id AND b.i = t.i - 1)
SELECT conv_id, CAST(0 AS BIGINT) AS part, count(*) AS n_turns, CAST(any_value(cost) AS BIGINT) AS cost,
       string_agg(CASE WHEN g[r + 1][before + 1][state + 1] THEN chr(10) || x
                       ELSE CASE WHEN i > 1 THEN {text(CLOSE)} ELSE '' END || e[r + 1][before + 1][state + 1] || {text(OPEN)} || ['', 'system', 'user', 'assistant'][state + 1] || {text(MIDDLE)} || x END
                  || CASE WHEN i = n THEN {text(CLOSE)} ELSE '' END, '' ORDER BY i) AS text
FROM p, k GROUP BY conv_id
"""


OP5_SQL = _oracle()
