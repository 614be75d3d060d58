"""Chat formatting by minimum-cost role repair: a conversation is brought into a legal order of turns, [system] (user assistant)*, by
dynamic programming over the automaton of legal turns, which chooses merges, new labels and empty insertions; then it is rendered.

Costs: keep 0, merge into the turn before 1, an empty turn 2, another label 4 (1 for a role that is none of the three, or null). Of
repairs of equal cost one with the fewest turns is taken. It ends with an assistant's turn unless `final` says otherwise. Turns are ordered by
turn (null last), then role, then text; repeated rows are turns like any other. A null text is empty. Rows without conv_id are one
conversation. Merged texts are joined by a blank line. In texts '<|' is rendered as '< |', so that no text looks like a mark. Other columns are
ignored. No turns: no rows. A merged turn is one row however long.

A long conversation may span tasks: each finds the best costs between any two states over its own run of turns, the driver
joins these (two for each task, whatever the input), and each task then repairs its run between the states so found.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table

ROLES = ("system", "user", "assistant")
BEGIN = 3
STATES = (0, 1, 2, BEGIN)
LEGAL = {BEGIN: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
MERGE, RELABEL, NAME, INSERT = 1, 4, 1, 2
#: Turns and bytes of text of a task, about.
TURNS, BYTES = 20_000, 32 << 20
FAR = (1 << 40, 0)


@lru_cache
def insertions(state: int, most: int = 2) -> tuple[tuple[int, tuple[int, ...]], ...]:
    """States that empty turns lead to, and these turns."""
    found = [(state, ())]
    for _ in range(most):
        found += [(n, (*way, n)) for s, way in found for n in LEGAL[s]]
    best: dict[int, tuple[int, ...]] = {}
    for s, way in sorted(found, key=lambda x: (len(x[1]), x[1])):
        best.setdefault(s, way)
    return tuple(sorted(best.items()))


def label_cost(role: int | None, as_role: int) -> int:
    return 0 if role == as_role else NAME if role is None else RELABEL


@lru_cache
def moves(role: int | None) -> dict[tuple[int, int], tuple[int, int, tuple[int, ...], bool]]:
    """Best way of one turn from a state to another: cost, turns added, empty turns before it, whether it is merged."""
    out: dict = {}
    for start in STATES:
        for at, way in insertions(start):
            base = INSERT * len(way)
            ways = [(base + label_cost(role, n), len(way) + 1, way, False, n) for n in LEGAL[at]]
            if at != BEGIN:
                ways.append((base + MERGE + label_cost(role, at), len(way), way, True, at))
            for cost, turns, before, merged, end in ways:
                if (cost, turns, merged) < (*out.get((start, end), (*FAR, 0, False))[:2], out.get((start, end), (0, 0, 0, True))[3]):
                    out[start, end] = (cost, turns, before, merged)
    return out


def step(costs: dict[int, tuple[int, int]], role: int | None) -> tuple[dict[int, tuple[int, int]], dict[int, int]]:
    """Best (cost, turns) of each state after one more turn, and the state before."""
    new: dict[int, tuple[int, int]] = {}
    back: dict[int, int] = {}
    for (start, end), (cost, turns, _, _) in moves(role).items():
        if start in costs:
            c = costs[start]
            x = (c[0] + cost, c[1] + turns)
            if end not in new or x < new[end]:
                new[end], back[end] = x, start
    return new, back


def closing(state: int, final: tuple[int, ...]) -> tuple[int, ...] | None:
    """Empty turns that end a conversation legally."""
    ways = [way for s, way in insertions(state) if s in final]
    return min(ways, key=lambda w: (len(w), w)) if ways else None


def between(roles: list[int | None]) -> dict[tuple[int, int], tuple[int, int]]:
    """Best (cost, turns) over a run of turns for each pair of states."""
    out = {}
    for start in STATES:
        costs = {start: (0, 0)}
        for r in roles:
            costs = step(costs, r)[0]
        out |= {(start, end): x for end, x in costs.items()}
    return out


def best_end(costs: dict[int, tuple[int, int]], final: tuple[int, ...]) -> int:
    """The state to stop in, closing turns counted."""
    return min((c[0] + INSERT * len(w), c[1] + len(w), s) for s, c in costs.items() if (w := closing(s, final)) is not None)[2]


def path(roles: list[int | None], start: int, end: int | None, final: tuple[int, ...]) -> list[int]:
    """States before the first and after each turn; without `end`, the conversation stops here."""
    costs, backs = {start: (0, 0)}, []
    for r in roles:
        costs, back = step(costs, r)
        backs.append(back)
    states = [best_end(costs, final) if end is None else end]
    for back in reversed(backs):
        states.append(back[states[-1]])
    return states[::-1]


def repaired(roles: list[int | None], texts: list[str], start: int = BEGIN, end: int | None = None, final: tuple[int, ...] = (2,)) -> list[dict]:
    """Turns of the repaired run: role, texts, cost, and what was done. The first may continue a turn of the run before (joins)."""
    states, out = path(roles, start, end, final), []

    def empty(role: int):
        out.append({"role": role, "texts": [], "cost": INSERT, "merged": 0, "relabelled": 0, "inserted": 1, "joins": False})

    for k, (role, text) in enumerate(zip(roles, texts, strict=True)):
        _, _, before, merged = moves(role)[states[k], states[k + 1]]
        for n in before:
            empty(n)
        cost = label_cost(role, states[k + 1])
        if merged and not out:
            out.append({"role": states[k + 1], "texts": [], "cost": 0, "merged": 0, "relabelled": 0, "inserted": 0, "joins": True})
        if not merged:
            out.append({"role": states[k + 1], "texts": [], "cost": 0, "merged": 0, "relabelled": 0, "inserted": 0, "joins": False})
        t = out[-1]
        t["texts"].append(text)
        t["cost"] += cost + MERGE * merged
        t["merged"] += int(merged)
        t["relabelled"] += int(cost > 0)
    if end is None:
        for n in closing(states[-1], final) or ():
            empty(n)
    return out


def render(role: str, text: str) -> str:
    return f"<|im_start|>{role}\n{text}<|im_end|>\n"


TURN = "conv_id long, turn long, role string, text string, cost long, merged long, relabelled long, inserted long, part long, open boolean"


def _role(x) -> int | None:
    return ROLES.index(x) if x in ROLES else None


def _runs(pdf):
    """(conv_id, first row, end row) of each conversation in sorted rows."""
    ids = [None if x is None or x != x else int(x) for x in pdf.conv_id.astype(object)]
    at = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[at]:
            yield ids[at], at, k
            at = k


def _edges(key, pdf):
    """The first and the last conversation of a task, with their costs between states."""
    import pandas as pd

    pdf = pdf.sort_values("seq")
    runs, roles = list(_runs(pdf)), [_role(x) for x in pdf.role]
    rows = []
    for conv_id, a, b in dict.fromkeys((runs[0], runs[-1])):
        rows.append((int(pdf.pid.iloc[0]), conv_id, b - a, [[s, e, c, n] for (s, e), (c, n) in between(roles[a:b]).items()]))
    return pd.DataFrame(rows, columns=["pid", "conv_id", "rows", "ways"]).astype({"conv_id": "Int64"})


def joined(edges: list[tuple[int, int | None, list]], final: tuple[int, ...]) -> dict[tuple[int, int | None], tuple[int, int | None, int]]:
    """For conversations that span tasks: the state each task starts and ends in (None: it stops there) and the turns before."""
    by: dict = {}
    for pid, conv_id, ways in sorted(edges, key=lambda e: e[0]):
        by.setdefault(conv_id, []).append((pid, {(s, e): (c, n) for s, e, c, n in ways}))
    out = {}
    for conv_id, runs in by.items():
        if len(runs) < 2:
            continue
        costs, backs = {BEGIN: (0, 0)}, []
        for _, ways in runs:
            new, back = {}, {}
            for (s, e), (c, n) in ways.items():
                if s in costs and (x := (costs[s][0] + c, costs[s][1] + n)) < new.get(e, FAR):
                    new[e], back[e] = x, s
            costs = new
            backs.append(back)
        states = [best_end(costs, final)]
        for back in reversed(backs):
            states.append(back[states[-1]])
        states, turns = states[::-1], 0
        for k, (pid, ways) in enumerate(runs):
            out[pid, conv_id] = (states[k], states[k + 1] if k + 1 < len(runs) else None, turns)
            turns += ways[states[k], states[k + 1]][1]
    return out


def chat_turns(conversations: DataFrame, final: tuple[str, ...] = ("assistant",), turns: int = TURNS) -> DataFrame:
    """Repaired turns of conversations(conv_id, turn, role, text): conv_id, turn (from 0), role, text, rendered, cost, merged, relabelled, inserted."""
    spark, ends = conversations.sparkSession, tuple(ROLES.index(r) for r in final)
    tmp = Scratch(spark, "chat")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv_id"), F.col("turn").asc_nulls_last(), F.col("role"), F.col("text")]
    held = c.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    parts = max(1, -(-held.n // turns), -(-held["size"] // BYTES))
    # ties fall where they may, so a row's own hash spreads a conversation without turn numbers too
    dealt = c.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt = tmp.save(dealt.select("*", F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("seq")), "dealt")
    edges = dealt.groupBy("pid").applyInPandas(lambda key, pdf: _edges(key, pdf[["pid", "seq", "conv_id", "role"]]), "pid int, conv_id long, rows long, ways array<array<long>>")
    sent = spark.sparkContext.broadcast(joined([(r.pid, r.conv_id, r.ways) for r in edges.collect()], ends))

    def repair(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values("seq")
        roles, texts, pid, rows = [_role(x) for x in pdf.role], list(pdf.text), int(pdf.pid.iloc[0]), []
        for conv_id, a, b in _runs(pdf):
            start, end, n = sent.value.get((pid, conv_id), (BEGIN, None, 0))
            spans = (pid, conv_id) in sent.value
            found = repaired(roles[a:b], texts[a:b], start, end, ends)
            n -= bool(found and found[0]["joins"])
            for k, t in enumerate(found):
                # a turn at the edge of a task may go on in the next
                rows.append((conv_id, n + k, ROLES[t["role"]], "\n\n".join(t["texts"]), t["cost"], t["merged"], t["relabelled"], t["inserted"], pid, spans and k in (0, len(found) - 1)))
        names = [x.split()[0] for x in TURN.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64"})

    found = tmp.save(dealt.groupBy("pid").applyInPandas(repair, TURN), "turns")
    whole = found.where("not open").drop("part", "open")
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda s: s["text"])
    open_ = found.where("open").groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_join(pieces, "\n\n").alias("text"), *[F.sum(x).alias(x) for x in ("cost", "merged", "relabelled", "inserted")])
    rendered = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), F.replace("text", F.lit("<|"), F.lit("< |")), F.lit("<|im_end|>\n"))
    return whole.unionByName(open_).withColumn("rendered", rendered)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each repaired turn."""
    return chat_turns(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "cost", "merged", "relabelled", "inserted", "rendered")
