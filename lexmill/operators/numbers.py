"""Modular arithmetic and linear recurrences beyond 64 bits, as folds over an exponent's bits, and graphs by the thousand."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as S

from lexmill.functions.shared import cut, few_or_all
from lexmill.plans.registry import query, read

# -- modular arithmetic -----------------------------------------------------------------------------------------------


def times(a: str, b: str, m: str) -> str:
    """SQL of a * b modulo m for numbers of up to 63 bits: products have up to 126 bits, which a decimal of 38 digits holds."""
    d = "DECIMAL(19, 0)"
    return f"CAST(CAST({a} AS {d}) * CAST({b} AS {d}) % CAST({m} AS {d}) AS BIGINT)"


def mod_pow(base: str, exponent: str, m: str) -> str:
    """SQL of base ** exponent modulo m, for exponents from 0 on; null where m is not positive."""
    step = f"named_struct('r', IF(shiftright({exponent}, k) & 1 = 1, {times('s.r', 's.b', m)}, s.r), 'b', {times('s.b', 's.b', m)})"
    bits = f"sequence(0, length(bin({exponent})) - 1)"
    return f"CASE WHEN {m} > 0 AND {exponent} >= 0 THEN aggregate({bits}, named_struct('r', 1L % {m}, 'b', pmod({base}, {m})), (s, k) -> {step}, s -> s.r) END"


def gcd(a: str, b: str) -> str:
    """SQL of Euclid's algorithm; each two steps halve the smaller number, so 92 steps are enough for 64 bits."""
    return f"abs(aggregate(sequence(1, 92), named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT)), (s, k) -> IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a % IF(s.b = 0, 1L, s.b))), s -> s.a))"


# The operations of modular claims.
OPERATIONS = ["gcd", "lcm", "mod_pow", "mod_reduce", "fermat_little_check"]
_MODULAR_CLAIMS = """SELECT o_orderkey AS claim_id, CAST(o_orderkey % 5 AS INT) AS op, o_orderkey * 1000003 + 7 AS a, CASE o_orderkey % 5 WHEN 1 THEN (o_custkey + 1) * 30030 WHEN 2 THEN 4611686018427387904 - o_orderkey ELSE (o_custkey + 1) * 30030 END AS b,
 CASE o_orderkey % 5 WHEN 3 THEN o_custkey + 2 WHEN 4 THEN CASE o_custkey % 3 WHEN 0 THEN 1000000007 WHEN 1 THEN 2147483647 ELSE o_custkey + 2 END ELSE 9223372036854775783 - o_custkey END AS m, o_custkey % 4 + 1 AS claimed FROM orders"""


@query(
    f"""WITH RECURSIVE c AS MATERIALIZED ({_MODULAR_CLAIMS}), e AS (SELECT claim_id, op, a, CASE op WHEN 4 THEN m - 1 ELSE b END AS b, m FROM c WHERE op IN (2, 4)),
p(claim_id, k, r, s, e, m) AS (SELECT claim_id, 0, 1::HUGEINT % m, ((a % m)::HUGEINT + m) % m, b::HUGEINT, m::HUGEINT FROM e
 UNION ALL SELECT claim_id, k + 1, CASE WHEN e % 2 = 1 THEN r * s % m ELSE r END, s * s % m, e // 2, m FROM p WHERE e > 0),
w AS (SELECT claim_id, r::BIGINT AS power FROM p WHERE e = 0),
t AS (SELECT claim_id, op, a, m, claimed, CASE op WHEN 0 THEN gcd(a, b) WHEN 1 THEN CASE WHEN a::HUGEINT // gcd(a, b) * b <= 9223372036854775807 THEN (a::HUGEINT // gcd(a, b) * b)::BIGINT END WHEN 2 THEN power WHEN 3 THEN ((a % m)::HUGEINT + m) % m
 ELSE CASE WHEN a % m <> 0 AND power = 1 THEN 1 ELSE 0 END END::BIGINT AS actual FROM c LEFT JOIN w USING (claim_id))
SELECT claim_id, CASE op WHEN 0 THEN 'gcd' WHEN 1 THEN 'lcm' WHEN 2 THEN 'mod_pow' WHEN 3 THEN 'mod_reduce' ELSE 'fermat_little_check' END AS operation, actual, CASE op WHEN 4 THEN (actual = 1) = (claimed <= 2) ELSE actual = claimed END AS verified FROM t"""
)
def modular_claims(spark, sf_dir):
    """Claims of five operations with exponents of 62 bits and moduli of 63; a multiple beyond 64 bits is null."""
    columns = _MODULAR_CLAIMS.removeprefix("SELECT ").removesuffix(" FROM orders")
    rows = read(spark, sf_dir, "orders").selectExpr(*_parts(columns))
    actual = f"""CASE op WHEN 0 THEN {gcd('a', 'b')} WHEN 1 THEN try_multiply(a div {gcd('a', 'b')}, b) WHEN 2 THEN {mod_pow('a', 'b', 'm')} WHEN 3 THEN pmod(a, m)
     ELSE CASE WHEN a % m <> 0 AND {mod_pow('a', '(m - 1)', 'm')} = 1 THEN 1L ELSE 0L END END"""
    names = F.array(*map(F.lit, OPERATIONS))
    rows = rows.withColumn("actual", F.expr(actual))
    return rows.select("claim_id", F.get(names, "op").alias("operation"), "actual", F.expr("CASE op WHEN 4 THEN (actual = 1) = (claimed <= 2) ELSE actual = claimed END").alias("verified"))


def _parts(columns: str) -> list[str]:
    """The parts between commas outside brackets."""
    out, depth = [""], 0
    for c in columns:
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]


# -- recurrences ------------------------------------------------------------------------------------------------------


def recurrence(coefficients: list[str], initial: list[str], n: str, m: str) -> str:
    """SQL of u(n) modulo m, where u(k) is the sum of coefficients[i] * u(k - 1 - i): the companion matrix's power by n's bits.

    For few rows: with_terms() takes a small part of its time.
    """
    k = len(coefficients)
    entry = lambda r, c: f"pmod({coefficients[c]}, {m})" if r == 0 else f"{int(c == r - 1)}L"
    start = "array(" + ", ".join(f"CAST({entry(r, c)} AS BIGINT)" for r in range(k) for c in range(k)) + ")"
    one = "array(" + ", ".join(f"{int(r == c)}L % {m}" for r in range(k) for c in range(k)) + ")"

    def product(x: str, y: str) -> str:
        cell = lambda r, c: "pmod(" + " + ".join(f"CAST({times(f'{x}[{r * k + i}]', f'{y}[{i * k + c}]', m)} AS DECIMAL(38, 0))" for i in range(k)) + f", CAST({m} AS DECIMAL(38, 0)))"
        return "array(" + ", ".join(f"CAST({cell(r, c)} AS BIGINT)" for r in range(k) for c in range(k)) + ")"

    step = f"named_struct('r', IF(shiftright({n}, i) & 1 = 1, {product('s.r', 's.b')}, s.r), 'b', {product('s.b', 's.b')})"
    power = f"aggregate(sequence(0, length(bin({n})) - 1), named_struct('r', {one}, 'b', {start}), (s, i) -> {step}, s -> s.r)"
    # the last row times the initial values, the newest first
    last = " + ".join(f"CAST({times(f'p[{(k - 1) * k + i}]', f'pmod({initial[k - 1 - i]}, {m})', m)} AS DECIMAL(38, 0))" for i in range(k))
    return f"transform(array({power}), p -> CAST(pmod({last}, CAST({m} AS DECIMAL(38, 0))) AS BIGINT))[0]"


def terms(coefficients: list[np.ndarray], initial: list[np.ndarray], n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """u(n) modulo m of each row, where u(k) is the sum of coefficients[i] * u(k - 1 - i): x ** n modulo the recurrence's polynomial.

    Arrays are of 64 bits, where products of numbers below m fit, or of Python's numbers.
    """
    k = len(coefficients)
    c = [x % m for x in coefficients]
    r = [np.zeros_like(m) + int(i == 0) for i in range(k)]
    for bit in range(int(n.max(initial=0)).bit_length() - 1, -1, -1):
        square = [sum(r[i] * r[d - i] for i in range(max(0, d - k + 1), min(d, k - 1) + 1)) for d in range(2 * k - 1)]
        for d in range(2 * k - 2, k - 1, -1):
            top = square[d] % m
            for j in range(k):
                square[d - 1 - j] = square[d - 1 - j] + top * c[j]
        r = [x % m for x in square[:k]]
        up = [(r[i - 1] if i else 0) + r[k - 1] * c[k - 1 - i] for i in range(k)]
        odd = (n >> bit & 1).astype(bool)
        r = [np.where(odd, x % m, y) for x, y in zip(up, r, strict=True)]
    return sum(x * (u % m) % m for x, u in zip(r, initial, strict=True)) % m


def with_terms(rows: DataFrame, coefficients: list[str], initial: list[str], n: str, m: str, value: str) -> DataFrame:
    """rows with column value, the terms() of their columns of whole numbers; null where n is negative, m not positive, or one is null."""
    read_from = [*coefficients, *initial, n, m]
    k = len(coefficients)
    small = math.isqrt((2**63 - 1) // (2 * k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in read_from]
            valid = np.all([x.is_valid().to_numpy(zero_copy_only=False) for x in columns], axis=0)
            own = [x.fill_null(0).to_numpy() for x in columns]
            valid &= (own[-2] >= 0) & (own[-1] > 0)
            out = np.zeros(batch.num_rows, np.int64)
            # rows alike in the bits of n take as many steps, and those of small m have no need of Python's numbers
            for long in (False, True):
                for large in (False, True):
                    at = np.nonzero(valid & ((own[-2] >= 1 << 16) == long) & ((own[-1] > small) == large))[0]
                    if len(at):
                        some = [x[at].astype(object if large else np.int64) for x in own]
                        out[at] = terms(some[:k], some[k : 2 * k], *some[2 * k :]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, mask=~valid)], [*batch.schema.names, value])

    rows = rows.withColumns({c: F.col(c).cast("long") for c in read_from})
    return rows.mapInArrow(run, S.StructType([*rows.schema.fields, S.StructField(value, S.LongType())]))


_RECURRENCES = """SELECT o_orderkey AS claim_id, o_custkey % 10 - 3 AS c0, o_orderkey % 7 + 1 AS c1, o_orderkey % 3 - 1 AS c2, o_custkey % 11 AS u0, o_orderkey % 13 AS u1, CAST(1 AS BIGINT) AS u2,
 CASE o_orderkey % 2 WHEN 0 THEN o_custkey % 40 ELSE (o_orderkey * 7919 + o_custkey) * 1000003 END AS n, CASE o_orderkey % 3 WHEN 0 THEN 1000000007 WHEN 1 THEN 9223372036854775783 ELSE o_custkey + 2 END AS m, o_custkey % 2 AS claimed FROM orders"""
_K = 3
_sum = lambda x, y, r, c: "(" + " + ".join(f"{x}{r}{i} * {y}{i}{c} % m" for i in range(_K)) + ") % m"
_CELLS = [(r, c) for r in range(_K) for c in range(_K)]


@query(
    f"""WITH RECURSIVE c AS MATERIALIZED ({_RECURRENCES}),
p AS (SELECT claim_id, n::HUGEINT AS n, m::HUGEINT AS m, {', '.join(f'{int(r == c)}::HUGEINT % m AS r{r}{c}' for r, c in _CELLS)}, {', '.join((f'((c{c} % m)::HUGEINT + m) % m' if r == 0 else f'{int(c == r - 1)}::HUGEINT') + f' AS b{r}{c}' for r, c in _CELLS)} FROM c
 UNION ALL SELECT claim_id, n // 2, m, {', '.join(f'CASE WHEN n % 2 = 1 THEN {_sum("r", "b", r, c)} ELSE r{r}{c} END' for r, c in _CELLS)}, {', '.join(_sum('b', 'b', r, c) for r, c in _CELLS)} FROM p WHERE n > 0),
v AS (SELECT claim_id, ((r20 * (u2 % p.m) % p.m + r21 * (u1 % p.m) % p.m + r22 * (u0 % p.m) % p.m) % p.m)::BIGINT AS value, claimed FROM p JOIN c USING (claim_id) WHERE p.n = 0)
SELECT claim_id, value, value % 2 = claimed AS verified FROM v"""
)
def recurrence_values(spark, sf_dir):
    """Terms far out of recurrences of order three with coefficients, starts and moduli of each row; the claim is their parity."""
    rows = read(spark, sf_dir, "orders").selectExpr(*_parts(_RECURRENCES.removeprefix("SELECT ").removesuffix(" FROM orders")))
    rows = with_terms(rows, ["c0", "c1", "c2"], ["u0", "u1", "u2"], "n", "m", "value")
    return rows.select("claim_id", "value", (F.col("value") % 2 == F.col("claimed")).alias("verified"))


# -- graphs -----------------------------------------------------------------------------------------------------------


def labels(edges: DataFrame) -> DataFrame:
    """(graph, node, label): the smallest node reachable within each graph, for all graphs at once.

    A round takes the smallest label next door and then the label's own label, so a path of n nodes takes about log n.
    """
    both = cut(edges.select("graph", F.col("u").alias("node"), F.col("v").alias("other")).union(edges.select("graph", "v", "u")).distinct())
    state = cut(both.groupBy("graph", "node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        near = both.join(state.select("graph", F.col("node").alias("other"), "label"), ["graph", "other"]).groupBy("graph", "node").agg(F.min("label").alias("near"))
        step = state.join(near, ["graph", "node"]).select("graph", "node", F.col("label").alias("old"), F.least("label", "near").alias("up"))
        jump = state.select("graph", F.col("node").alias("up"), F.col("label").alias("top"))
        step = cut(step.join(jump, ["graph", "up"], "left").select("graph", "node", "old", F.least("up", F.coalesce("top", "up")).alias("label")))
        state = step.select("graph", "node", "label")
        if step.filter("old != label").isEmpty():
            return state


def smallest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of n nodes that each is linked with by edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        up = label.copy()
        np.minimum.at(up, label[a], low)
        np.minimum.at(up, label[b], low)
        while (up != up[up]).any():
            up = up[up]
        if (up == label).all():
            return up
        label = up


def facts_of(graph: np.ndarray, u: np.ndarray, v: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, ...]:
    """The facts of graphs numbered from 0 on; rows that are alone have a vertex u and no edge."""
    pairs, node = np.unique(np.stack([np.concatenate([graph, graph[~alone]]), np.concatenate([u, v[~alone]])]), axis=1, return_inverse=True)
    owner, n = pairs[0], pairs.shape[1]
    node = node.reshape(-1)
    ends = np.unique(np.stack([node[: len(u)][~alone], node[len(u) :]]), axis=1)
    a, b = ends
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    # each vertex twice, edges crossing over: the two meet where a walk of odd length leads back
    label = smallest(np.concatenate([2 * a, 2 * a + 1]), np.concatenate([2 * b + 1, 2 * b]), 2 * n).reshape(n, 2)
    first = label.min(axis=1) >> 1 == np.arange(n)
    graphs = int(owner.max(initial=-1)) + 1
    count = lambda mask: np.bincount(owner[mask], minlength=graphs)
    most = np.zeros(graphs, np.int64)
    np.maximum.at(most, owner, degree)
    total = np.bincount(owner, degree, graphs).astype(np.int64)
    return count(slice(None)), total // 2, total, most, count(degree % 2 == 1), count(first) == 1, count((label[:, 0] == label[:, 1]) & (degree > 0)) == 0


def facts_in_tasks(rows: DataFrame) -> DataFrame:
    """The facts of graphs of few rows (graph, u, v), where v is null for a vertex alone; a task takes some thousands at once."""
    kinds = {c: S.LongType() for c in ("vertices", "edges", "degree_sum", "max_degree", "odd")} | {c: S.BooleanType() for c in ("connected", "bipartite")}

    def told(table: pa.Table) -> pa.RecordBatch:
        graph = table.column("graph").combine_chunks().dictionary_encode(null_encoding="encode")
        alone = table.column("v").is_null().to_numpy()
        facts = facts_of(graph.indices.to_numpy(), table.column("u").to_numpy(), table.column("v").fill_null(0).to_numpy(), alone)
        return pa.RecordBatch.from_arrays([graph.dictionary, *map(pa.array, facts)], ["graph", *kinds])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            # the last graph may go on in the next batch
            codes = held.column("graph").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            whole = int(np.searchsorted(codes, codes[-1]))
            if whole:
                yield told(held.slice(0, whole))
                held = held.slice(whole)
        if held is not None:
            yield told(held)

    dealt = rows.select("graph", F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    # by a hash, so that no join before counts as having dealt them
    dealt = dealt.repartition(F.xxhash64("graph")).sortWithinPartitions("graph")
    return dealt.mapInArrow(run, S.StructType([dealt.schema["graph"], *(S.StructField(c, k) for c, k in kinds.items())]))


#: Rows of a graph that a task may take whole; larger ones are spread over tasks.
SMALL = 10_000


def graph_facts(edges: DataFrame, alone: DataFrame | None = None) -> DataFrame:
    """One row a graph of undirected edges (graph, u, v), repeated ones being one, and vertices (graph, u) that may have none.

    vertices, edges, degree_sum, max_degree, odd (vertices), connected, bipartite, eulerian, eulerian_path, tree. A loop adds
    two to its vertex's degree, and no graph with one is bipartite or a tree. Vertices are long numbers.
    """
    rows = edges.select("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u is not null")
    if alone is not None:
        rows = rows.unionByName(alone.select("graph", "u", F.lit(None).cast("long").alias("v")).filter("u is not null"))
    large = cut(rows.groupBy("graph").agg(F.count("*").alias("n")).filter(f"n > {SMALL}").select(F.col("graph").alias("other")))
    of = few_or_all(large)
    same = F.col("graph").eqNullSafe(F.col("other"))
    out = facts_in_tasks(rows.join(of, same, "left_anti"))
    if not large.isEmpty():
        most = rows.join(of, same, "left_semi")
        out = out.unionByName(spread_facts(most.filter("v is not null"), most.filter("v is null").select("graph", "u")).select(*out.columns))
    c = F.col("connected")
    return out.select("*", (c & (F.col("odd") == 0)).alias("eulerian"), (c & F.col("odd").isin(0, 2)).alias("eulerian_path"), (c & (F.col("edges") == F.col("vertices") - 1)).alias("tree"))


def spread_facts(edges: DataFrame, alone: DataFrame) -> DataFrame:
    """The facts of graphs of any size, vertex by vertex."""
    edges = cut(edges.select("graph", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ends = edges.select("graph", F.explode(F.array("u", "v")).alias("node"))
    degrees = ends.groupBy("graph", "node").agg(F.count("*").alias("degree"))
    degrees = degrees.unionByName(alone.select("graph", F.col("u").alias("node"), F.lit(0).cast("long").alias("degree"))).groupBy("graph", "node").agg(F.max("degree").alias("degree"))
    # each vertex twice, edges crossing over: the two meet where a walk of odd length leads back
    twice = edges.select("graph", (F.col("u") * 2).alias("u"), (F.col("v") * 2 + 1).alias("v")).union(edges.select("graph", F.col("u") * 2 + 1, F.col("v") * 2))
    found = labels(twice).groupBy("graph", F.shiftright("node", 1).alias("node")).agg(F.shiftright(F.min("label"), 1).alias("part"), (F.min("label") != F.max("label")).alias("even"))
    rows = degrees.join(found, ["graph", "node"], "left").withColumn("part", F.coalesce("part", "node"))
    parts = rows.groupBy("graph", "part").agg(F.count("*").alias("n"), F.sum("degree").alias("degrees"), F.max("degree").alias("most"), F.count_if(F.col("degree") % 2 == 1).alias("odd"), F.bool_and(F.coalesce("even", F.lit(True))).alias("even"))
    return parts.groupBy("graph").agg(F.sum("n").alias("vertices"), F.expr("sum(degrees) div 2").alias("edges"), F.sum("degrees").alias("degree_sum"), F.max("most").alias("max_degree"), F.sum("odd").alias("odd"), (F.count("*") == 1).alias("connected"), F.bool_and("even").alias("bipartite"))


_EDGES = "SELECT l_orderkey AS graph, l_partkey % 6 AS u, l_suppkey % 6 AS v FROM lineitem"


@query(
    f"""WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT graph, least(u, v) AS u, greatest(u, v) AS v FROM ({_EDGES})),
a AS MATERIALIZED (SELECT graph, u, v FROM e UNION SELECT graph, v, u FROM e), d AS (SELECT graph, node, count(*) AS degree FROM (SELECT graph, u AS node FROM e UNION ALL SELECT graph, v FROM e) GROUP BY ALL),
w(graph, s, node, odd) AS (SELECT DISTINCT graph, node, node, false FROM d UNION SELECT w.graph, w.s, a.v, NOT w.odd FROM w JOIN a ON a.graph = w.graph AND a.u = w.node),
r AS (SELECT graph, s, count(DISTINCT node) AS reached, bool_or(odd AND node = s) AS cycle FROM w GROUP BY ALL),
g AS (SELECT graph, count(*) AS vertices, (sum(degree) // 2)::BIGINT AS edges, sum(degree)::BIGINT AS degree_sum, max(degree) AS max_degree, count(*) FILTER (WHERE degree % 2 = 1) AS odd FROM d GROUP BY graph),
h AS (SELECT graph, bool_and(reached = vertices) AS connected, NOT bool_or(cycle) AS bipartite FROM r JOIN g USING (graph) GROUP BY graph)
SELECT graph, vertices, edges, degree_sum, max_degree, odd, connected, bipartite, connected AND odd = 0 AS eulerian, connected AND odd IN (0, 2) AS eulerian_path, connected AND edges = vertices - 1 AS tree FROM g JOIN h USING (graph)"""
)
def graph_properties(spark, sf_dir):
    """One small graph for each order: its degrees, whether it is connected, bipartite, Eulerian, a tree."""
    return graph_facts(read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS graph", "l_partkey % 6 AS u", "l_suppkey % 6 AS v"))
