"""The queries as DuckDB SQL, from the same arithmetic rules."""

from __future__ import annotations

from tidegraph.functions.numeric import HASHES, LABEL
from tidegraph.operators.propagate import MAX_SWEEPS
from tidegraph.queries import BATCH, DEGREE, LAST, SWEEPS, SWINGS, TAU
from tidegraph.sources.fixtures import BATCHES, LEAST

STEP, CAP = LABEL // 10_000, MAX_SWEEPS

GRAPH = f"""
v0 AS (
  SELECT vec_id AS id, CAST(label % 2 AS INTEGER) AS true_label,
         CAST(CASE WHEN vec_id % 20 = 0 THEN 0 ELSE 1 + vec_id % 4 END AS INTEGER) AS batch_id,
         vec_id % 20 = 0 OR vec_id % 50 = 7 AS known FROM embeddings
), v AS MATERIALIZED (
  SELECT id, true_label, batch_id,
         CAST(CASE WHEN NOT known AND id % 11 = 3 THEN least(batch_id + (id // 22) % 2, {BATCHES - 1}) END AS INTEGER) AS delete_batch,
         CASE WHEN known THEN true_label END AS gt_class FROM v0
), e AS MATERIALIZED (
  SELECT * FROM (
    SELECT a.vec_id AS src, b.vec_id AS dst,
           CAST(round((1 + list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) / 2 * 1000000) AS BIGINT) AS w
    FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE w >= {LEAST}
), lines AS MATERIALIZED (
  SELECT src, dst, w, greatest(a.batch_id, b.batch_id) AS starts, least(a.delete_batch, b.delete_batch) AS ends
  FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst
), both_ways AS (SELECT src AS id, dst AS nbr, w FROM e UNION ALL SELECT dst, src, w FROM e)"""

#: The dense bipartite graph of parts and suppliers.
TRADE = f"""
e AS MATERIALIZED (
  SELECT least(p, s) AS src, greatest(p, s) AS dst, CAST(least(sum(q) * 10000, 1000000) AS BIGINT) AS w
  FROM (SELECT l_partkey * 2 AS p, l_suppkey * 2 + 1 AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem) GROUP BY ALL
), v0 AS (
  SELECT id, CAST((id // 2) % 2 AS INTEGER) AS true_label, CAST(CASE WHEN id % 20 = 0 THEN 0 ELSE 1 + id % 4 END AS INTEGER) AS batch_id,
         id % 20 = 0 OR id % 50 = 7 AS known FROM (SELECT src AS id FROM e UNION SELECT dst FROM e)
), v AS MATERIALIZED (
  SELECT id, true_label, batch_id,
         CAST(CASE WHEN NOT known AND id % 11 = 3 THEN least(batch_id + (id // 22) % 2, {BATCHES - 1}) END AS INTEGER) AS delete_batch,
         CASE WHEN known THEN true_label END AS gt_class FROM v0
), lines AS MATERIALIZED (
  SELECT src, dst, w, greatest(a.batch_id, b.batch_id) AS starts, least(a.delete_batch, b.delete_batch) AS ends
  FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst
)"""


def live(b: int, alias: str = "") -> str:
    return f"({alias}batch_id <= {b} AND ({alias}delete_batch IS NULL OR {alias}delete_batch > {b}))"


def state(b: int, p: str = "") -> str:
    """CTEs of batch b: alive, known, open, act (active edges), adj, fresh (new edges), newv, strong, seeds."""
    return f"""
{p}alive AS MATERIALIZED (SELECT * FROM v WHERE {live(b)}),
{p}known AS MATERIALIZED (SELECT id, gt_class FROM {p}alive WHERE gt_class IS NOT NULL),
{p}open AS MATERIALIZED (SELECT id FROM {p}alive WHERE gt_class IS NULL),
{p}act AS MATERIALIZED (SELECT src, dst, w FROM lines WHERE starts <= {b} AND (ends IS NULL OR ends > {b})),
{p}adj AS MATERIALIZED (SELECT src AS id, dst AS nbr, w FROM {p}act UNION ALL SELECT dst, src, w FROM {p}act),
{p}fresh AS MATERIALIZED (SELECT src, dst, w FROM lines WHERE starts = {b} AND (ends IS NULL OR ends > {b})),
{p}newv AS MATERIALIZED (SELECT id FROM {p}alive WHERE batch_id = {b}),
{p}strong AS MATERIALIZED (SELECT * FROM {p}fresh WHERE w > {TAU} AND src IN (FROM {p}newv) AND dst IN (FROM {p}newv)),
{p}cut AS MATERIALIZED (SELECT src, dst FROM lines WHERE starts <= {b} AND ends = {b}),
{p}gone AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM {p}cut UNION ALL SELECT dst FROM {p}cut) WHERE id IN (FROM {p}open)),
{p}near AS MATERIALIZED (SELECT DISTINCT id FROM (SELECT src AS id FROM {p}fresh WHERE w > {TAU} UNION ALL SELECT dst FROM {p}fresh WHERE w > {TAU}) WHERE id IN (FROM {p}open)),
{p}seeds AS MATERIALIZED (SELECT id FROM {p}gone UNION SELECT id FROM {p}near)"""


def comps(p: str, vertices: str, edges: str) -> str:
    return f"""
{p}reach(id, other) AS (
  SELECT id, id FROM {vertices}
  UNION
  SELECT r.id, x.nbr FROM {p}reach r JOIN (SELECT src AS id, dst AS nbr FROM {edges} UNION ALL SELECT dst, src FROM {edges}) x ON x.id = r.other
), {p}comp AS MATERIALIZED (SELECT id, min(other) AS root FROM {p}reach GROUP BY id)"""


def weights(p: str) -> str:
    return f"""
{p}sides AS MATERIALIZED (
  SELECT root, CAST(coalesce(sum(w) FILTER (gt_class = 0), 0) AS BIGINT) AS w0, CAST(coalesce(sum(w) FILTER (gt_class = 1), 0) AS BIGINT) AS w1
  FROM {p}adj a JOIN {p}comp c ON c.id = a.id JOIN {p}known k ON k.id = a.nbr GROUP BY root
)"""


def initial(p: str, comp: str = "") -> str:
    return f"""
{p}init AS MATERIALIZED (
  SELECT c.id, CAST(CASE WHEN k.gt_class IS NOT NULL THEN k.gt_class * {LABEL} WHEN coalesce(w0 + w1, 0) > 0
         THEN (2 * CAST(w1 AS HUGEINT) * {LABEL} + w0 + w1) // (2 * (w0 + w1)) ELSE {LABEL // 2} END AS BIGINT) AS f
  FROM {comp or p + 'comp'} c LEFT JOIN {p}sides s ON s.root = c.root LEFT JOIN {p}known k ON k.id = c.id
)"""


def averages(adj: str, labels: str) -> str:
    return f"""(SELECT a.id, CAST((2 * sum(CAST(a.w AS HUGEINT) * n.f) + sum(a.w)) // (2 * sum(a.w)) AS BIGINT) AS f
  FROM {adj} a JOIN {labels} n ON n.id = a.nbr GROUP BY a.id)"""


def sweeps(p: str, labels: str, k: int, full: bool = False) -> str:
    """CTEs {p}s0 .. {p}sk: labels after each sweep over the frontier from {p}seeds."""
    hot = "k.gt_class IS NULL" if full else f"k.gt_class IS NULL AND l.id IN (FROM {p}seeds)"
    out = [f"{p}s0 AS MATERIALIZED (SELECT l.id, CAST(coalesce(k.gt_class * {LABEL}, l.f) AS BIGINT) AS f, k.gt_class, {hot} AS hot FROM {labels} l LEFT JOIN {p}known k ON k.id = l.id)"]
    for i in range(1, k + 1):
        out.append(f"{p}n{i} AS MATERIALIZED (SELECT s.id, s.f AS old, s.gt_class, CASE WHEN s.hot THEN coalesce(m.f, s.f) ELSE s.f END AS f FROM {p}s{i - 1} s LEFT JOIN {averages(p + 'adj', f'{p}s{i - 1}')} m ON m.id = s.id)")
        moved = f"(SELECT id FROM {p}n{i} WHERE abs(f - old) > {STEP})"
        hot = "gt_class IS NULL" if full else f"gt_class IS NULL AND (id IN {moved} OR id IN (SELECT a.id FROM {p}adj a WHERE a.nbr IN {moved}))"
        out.append(f"{p}s{i} AS MATERIALIZED (SELECT id, f, gt_class, {hot} AS hot FROM {p}n{i})")
    return ",\n".join(out)


def settled(p: str, labels: str, full: bool = False, cap: int = CAP) -> str:
    """CTEs {p}run (every sweep to the stop rule) and {p}end (the last: i, id, f, movers)."""
    hot = "k.gt_class IS NULL" if full else f"k.gt_class IS NULL AND l.id IN (FROM {p}seeds)"
    following = "gt_class IS NULL" if full else f"gt_class IS NULL AND (id IN (FROM moved_) OR id IN (SELECT a.id FROM {p}adj a WHERE a.nbr IN (FROM moved_)))"
    return f"""
{p}run0 AS MATERIALIZED (
  SELECT l.id, CAST(coalesce(k.gt_class * {LABEL}, l.f) AS BIGINT) AS f, k.gt_class, {hot} AS hot FROM {labels} l LEFT JOIN {p}known k ON k.id = l.id
), {p}run(i, id, f, gt_class, hot, movers) AS (
  SELECT 0, id, f, gt_class, hot, (SELECT count(*) FROM {p}run0 WHERE hot) FROM {p}run0
  UNION ALL (
  WITH s AS MATERIALIZED (FROM {p}run),
  n AS MATERIALIZED (
    SELECT s.i + 1 AS i, s.id, s.f AS old, s.gt_class, CASE WHEN s.hot THEN coalesce(m.f, s.f) ELSE s.f END AS f
    FROM s LEFT JOIN {averages(p + 'adj', 's')} m ON m.id = s.id WHERE s.i < {cap} AND s.movers > 0
  ), moved_ AS MATERIALIZED (SELECT id FROM n WHERE abs(f - old) > {STEP})
  SELECT i, id, f, gt_class, {following}, (SELECT count(*) FROM moved_) FROM n)
), "{p}end" AS MATERIALIZED (SELECT i, id, f, movers FROM {p}run WHERE i = (SELECT max(i) FROM {p}run))"""


START = f"start AS MATERIALIZED (SELECT id, CAST(coalesce(gt_class * {LABEL}, (id % 101) * 1000000) AS BIGINT) AS f FROM alive)"
ONE = f"one AS MATERIALIZED (SELECT s.id, CASE WHEN k.gt_class IS NULL THEN coalesce(m.f, s.f) ELSE s.f END AS f FROM start s LEFT JOIN known k ON k.id = s.id LEFT JOIN {averages('adj', 'start')} m ON m.id = s.id)"
MOVED = f"moved AS MATERIALIZED (SELECT o.id FROM one o JOIN start s ON s.id = o.id WHERE abs(o.f - s.f) > {STEP * 100})"
HALF = f"half AS MATERIALIZED (SELECT id, CAST({LABEL // 2} AS BIGINT) AS f FROM alive)"


def sql(select: str, *ctes: str, graph: str = GRAPH) -> str:
    return "WITH RECURSIVE " + ",\n".join([graph, *ctes]) + "\n" + select


def status(b: int) -> str:
    return f"""SELECT id, CASE WHEN delete_batch <= {b} THEN 'DELETED' WHEN gt_class IS NOT NULL THEN 'GROUND_TRUTH' ELSE 'ACTIVE' END AS status,
  CAST(CASE WHEN delete_batch <= {b} THEN -1 ELSE coalesce(gt_class, -1) END AS INTEGER) AS gt_class FROM v WHERE batch_id <= {b}"""


def engine(settle: bool = False) -> tuple[list[str], list[str]]:
    """CTEs of all batches, the labels after batch b as l{b}; and a metrics row for each. The sweeps are fixed in number or go to the stop rule."""
    ctes, metrics = [], []
    for b in range(BATCHES):
        p = f"b{b}"
        ctes += [state(b, p), comps(p, f"{p}newv", f"{p}strong"), weights(p), initial(p)]
        passing = f"SELECT id, CAST({LABEL // 2} AS BIGINT) AS f FROM v WHERE batch_id = {b} AND NOT {live(b)}"
        before = f"SELECT id, f FROM l{b - 1} UNION ALL " if b else ""
        ctes.append(f"{p}all AS MATERIALIZED ({before}SELECT id, f FROM {p}init UNION ALL {passing})")
        ctes.append(f"{p}in AS MATERIALIZED (SELECT id, f FROM {p}all WHERE id IN (SELECT id FROM {p}alive))")
        ctes.append(settled(p, f"{p}in") if settle else sweeps(p, f"{p}in", SWEEPS))
        ctes.append(f"l{b} AS MATERIALIZED (SELECT id, f FROM {p}{'end' if settle else f's{SWEEPS}'} UNION ALL SELECT id, f FROM {p}all WHERE id NOT IN (SELECT id FROM {p}alive))")
        ran = " + ".join(f"CAST((SELECT count(*) FROM {p}s{i} WHERE hot) > 0 AS INTEGER)" for i in range(SWEEPS))
        if settle:
            ran = f"(SELECT max(i) FROM {p}end)"
        converged = f"(SELECT coalesce(max(movers), 0) = 0 FROM {p}end) AS converged, " if settle else ""
        metrics.append(f"""SELECT CAST({b} AS INTEGER) AS batch_id, (SELECT count(*) FROM {p}open) AS scored,
          (SELECT count(*) FROM l{b} JOIN v USING (id) WHERE id IN (FROM {p}open) AND (f >= {LABEL // 2}) = (true_label = 1)) AS correct,
          round(coalesce((SELECT avg(CAST((f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)) FROM l{b} JOIN v USING (id) WHERE id IN (FROM {p}open)), 1.0), 6) AS accuracy,
          CAST({ran} AS INTEGER) AS iterations, {converged}(SELECT count(DISTINCT root) FROM {p}comp) AS num_components, (SELECT count(*) FROM {p}strong) AS num_sub_edges""")
    return ctes, metrics


def deletions() -> str:
    ctes, gone = [], "SELECT id, delete_batch FROM d0"
    ctes.append("d0 AS (SELECT id, CAST(0 AS INTEGER) AS delete_batch FROM v WHERE false)")
    for b in range(1, BATCHES):
        ctes.append(f"""d{b} AS MATERIALIZED (SELECT id, CAST({b} AS INTEGER) AS delete_batch FROM (
          SELECT id, row_number() OVER (ORDER BY id % 83, id) AS place FROM v WHERE batch_id <= {b} AND gt_class IS NULL AND id NOT IN (SELECT id FROM ({gone})))
          WHERE place <= (SELECT CAST(floor(count(*) * 0.09) AS BIGINT) FROM v WHERE batch_id = {b}))""")
        gone += f" UNION ALL SELECT id, delete_batch FROM d{b}"
    return sql(gone, *ctes)


def hashed(*parts) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(map(str, parts))})), 1, 13) AS BIGINT)"


SEED = 42
N = "(SELECT n FROM size)"
MISSING = "(SELECT missing FROM size)"

#: The generated graph, a vertex a customer: one round of draws is enough for DEGREE.
MADE = f"""
size AS MATERIALIZED (SELECT n, greatest(n * {DEGREE} // 2, n - 1) - (n - 1) AS missing FROM (SELECT count(*) AS n FROM customer)),
labels AS MATERIALIZED (SELECT id, CAST(row_number() OVER (ORDER BY {hashed('id', SEED)}, id) > {N} // 2 AS INTEGER) AS true_label FROM (SELECT row_number() OVER () - 1 AS id FROM customer)),
backbone AS MATERIALIZED (
  SELECT least(id, other) AS src, greatest(id, other) AS dst FROM (SELECT id, lead(id) OVER (ORDER BY {hashed('id', SEED + 1)}, id) AS other FROM labels) WHERE other IS NOT NULL
), draws AS (
  SELECT {hashed('range', SEED + 2, "'a'")} % {N} AS a, {hashed('range', SEED + 2, "'b'")} % {N} AS b
  FROM (SELECT unnest(range(CAST(floor({MISSING} * 1.3) AS BIGINT) + 64)) AS range)
), drawn AS (
  SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM draws WHERE a <> b
), fresh AS MATERIALIZED (
  SELECT src, dst, row_number() OVER (ORDER BY {hashed('src', 'dst', SEED)}, src, dst) AS place FROM drawn ANTI JOIN backbone USING (src, dst)
), e0 AS MATERIALIZED (SELECT src, dst FROM backbone UNION ALL SELECT src, dst FROM fresh WHERE place <= {MISSING}),
e AS MATERIALIZED (
  SELECT src, dst, CASE WHEN a.true_label = b.true_label THEN 0.5::DOUBLE + 0.5::DOUBLE * u ELSE 0.01::DOUBLE + 0.49::DOUBLE * u END AS w
  FROM (SELECT src, dst, CAST({hashed('src', 'dst', SEED, "'w'")} AS DOUBLE) / {HASHES}::DOUBLE AS u FROM e0) JOIN labels a ON a.id = src JOIN labels b ON b.id = dst
)"""


def batches() -> str:
    """The vertices of the generated graph with their batches."""
    by = lambda what: f"{hashed('id', SEED + 12345, what)}, id"
    word = lambda what: by(f"'{what}'")
    ctes = [MADE, f"""
first AS MATERIALIZED (SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY true_label ORDER BY {word('start')}) AS place FROM labels) WHERE place <= greatest(2, {N} // 100) // 2),
placed AS MATERIALIZED (SELECT id, CAST(ntile({BATCHES - 1}) OVER (ORDER BY {word('batch')}) AS INTEGER) AS batch_id FROM labels WHERE id NOT IN (FROM first)),
chosen AS (SELECT id, row_number() OVER (PARTITION BY batch_id ORDER BY {word('known')}) AS place, count(*) OVER (PARTITION BY batch_id) AS n FROM placed),
vertices AS MATERIALIZED (
  SELECT id, true_label, coalesce(batch_id, 0) AS batch_id,
         CASE WHEN batch_id IS NULL OR id IN (SELECT id FROM chosen WHERE place <= greatest(1, floor(n * 0.01))) THEN true_label END AS gt_class
  FROM labels LEFT JOIN placed USING (id)
), d0 AS (SELECT id, CAST(0 AS INTEGER) AS delete_batch FROM vertices WHERE false)"""]  # fmt: skip
    gone = "SELECT id, delete_batch FROM d0"
    for b in range(1, BATCHES):
        ctes.append(f"""d{b} AS MATERIALIZED (SELECT id, CAST({b} AS INTEGER) AS delete_batch FROM (
          SELECT id, row_number() OVER (ORDER BY {word('gone')}) AS place FROM vertices WHERE batch_id <= {b} AND gt_class IS NULL AND id NOT IN (SELECT id FROM ({gone})))
          WHERE place <= (SELECT CAST(floor(count(*) * 0.09) AS BIGINT) FROM vertices WHERE batch_id = {b}))""")
        gone += f" UNION ALL SELECT id, delete_batch FROM d{b}"
    return "WITH " + ",\n".join(ctes) + f"""
SELECT id, true_label, CAST(batch_id AS INTEGER) AS batch_id, CAST(coalesce(delete_batch, -1) AS INTEGER) AS delete_batch, CAST(coalesce(gt_class, -1) AS INTEGER) AS gt_class
FROM vertices LEFT JOIN ({gone}) USING (id)"""


def lines(value: str, order: str, rows: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY {order}) - 1 AS place, {value} AS value FROM ({rows})"


B = BATCH
AT = state(B)
POINTERS = """SELECT CAST(0 AS BIGINT) AS place, CAST(0 AS BIGINT) AS pointer UNION ALL
      SELECT row_number() OVER (ORDER BY id), CAST(sum(n) OVER (ORDER BY id) AS BIGINT) FROM (SELECT v.id, count(nbr) AS n FROM v LEFT JOIN both_ways b ON b.id = v.id GROUP BY v.id)"""
FULL = (AT, HALF, sweeps("", "half", SWEEPS, full=True))
ENGINE, METRICS = engine()
SETTLED, SETTLED_METRICS = engine(settle=True)
REST = (AT, HALF, settled("", "half", full=True))

#: A row of counts for each graph that ``graph_violations`` looks at.
BROKEN = """
turned AS (SELECT dst AS src, src AS dst, -w AS w FROM e WHERE (src + dst) % 5 = 0),
bad_v AS (SELECT * FROM v WHERE id % 7 > 0 UNION ALL SELECT * FROM v WHERE id % 9 = 1),
bad_e AS (SELECT * FROM e UNION ALL SELECT * FROM turned UNION ALL SELECT * FROM turned)"""


def rules(name: str, v: str, e: str) -> str:
    counted = {
        "self_loop_or_order": f"FROM {e} WHERE src >= dst",
        "repeated_edge": f"FROM (SELECT src, dst FROM {e} GROUP BY ALL HAVING count(*) > 1)",
        "weight_not_positive": f"FROM {e} WHERE w <= 0",
        "repeated_vertex": f"FROM (SELECT id FROM {v} GROUP BY id HAVING count(*) > 1)",
        "unknown_endpoint": f"FROM (SELECT src FROM {e} UNION SELECT dst FROM {e}) WHERE src NOT IN (SELECT id FROM {v})",
        "known_vertex_deleted": f"FROM {v} WHERE gt_class IS NOT NULL AND delete_batch IS NOT NULL",
        "deleted_before_arrival": f"FROM {v} WHERE delete_batch < batch_id",
    }
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, '{name}' AS graph, count(*) AS n {rows}" for rule, rows in counted.items())


ORACLES = {
    "adjacency": sql("SELECT id, nbr, w FROM both_ways"),
    "degrees": sql("SELECT id, count(*) AS degree FROM both_ways GROUP BY id"),
    "csr_row_pointers": sql(POINTERS),
    "export_row_pointers": sql(f"SELECT place, CAST(pointer AS VARCHAR) AS value FROM ({POINTERS})"),
    "export_columns": sql(lines("CAST(nbr AS VARCHAR)", "id, nbr", "FROM both_ways")),
    "export_values": sql(lines("format('{:.6f}', CAST(w AS DOUBLE) / 1000000)", "id, nbr", "FROM both_ways")),
    "export_true_labels": sql(lines("id || ' ' || true_label", "id", "FROM v")),
    "export_predicted": sql(lines(f"id || ' ' || format('{{:.6f}}', CAST(f AS DOUBLE) / {LABEL})", "id", "FROM start"), AT, START),
    "export_metrics": sql("SELECT 0 AS place, 'batch,time_ms,accuracy' AS value UNION ALL SELECT row_number() OVER (ORDER BY batch_id), batch_id || ',' || format('{:.2f}', CAST(n AS DOUBLE)) || ',' || format('{:.6f}', batch_id / 8.0::DOUBLE) FROM (SELECT batch_id, count(*) AS n FROM v GROUP BY batch_id)"),
    "gen_labels": f"WITH {MADE} SELECT id, true_label FROM labels",
    "gen_backbone": f"WITH {MADE} SELECT src, dst FROM backbone",
    "gen_edges": f"WITH {MADE} SELECT src, dst FROM e0",
    "gen_weights": f"WITH {MADE} SELECT src, dst, w FROM e",
    "gen_graph": f"WITH {MADE} SELECT src, dst, w FROM e",
    "gen_batches": batches(),
    "command_line": f"""WITH {MADE}, n AS (SELECT {N} AS n), ids AS (SELECT n AS lines, CAST(n * (n - 1) // 2 AS BIGINT) AS total FROM n)
      SELECT 'RowPtr' AS file, {N} + 1 AS lines, CAST(2 * count(*) AS BIGINT) AS total FROM e
      UNION ALL SELECT 'ColInd', 2 * count(*), CAST(sum(src + dst) AS BIGINT) FROM e
      UNION ALL SELECT 'Values', 2 * count(*), CAST(2000000 * sum(CAST(format('{{:.6f}}', w) AS DECIMAL(18, 6))) AS BIGINT) FROM e
      UNION ALL SELECT 'TrueLabels', count(*), CAST(sum(true_label) AS BIGINT) FROM labels
      UNION ALL SELECT 'predicted', lines, total FROM ids UNION ALL SELECT 'baseline', lines, total FROM ids
      UNION ALL SELECT 'results', {BATCHES}, {BATCHES} * ({BATCHES} - 1) // 2""",
    "new_vertices": sql("SELECT id FROM newv", AT),
    "vertex_batches": sql("SELECT id, batch_id FROM v"),
    "initial_gt": sql("SELECT id, true_label AS gt_class FROM (SELECT *, row_number() OVER (PARTITION BY true_label ORDER BY id % 97, id) AS place FROM v) WHERE place <= greatest(2, (SELECT count(*) FROM v) // 50) // 2"),
    "batch_assign": sql(f"SELECT id, CAST(ntile({BATCHES - 1}) OVER (ORDER BY id % 97, id) AS INTEGER) AS batch_id FROM v WHERE id % 20 <> 0"),
    "batch_gt": sql("SELECT id, batch_id FROM (SELECT id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY id % 89, id) AS place, count(*) OVER (PARTITION BY batch_id) AS n FROM v WHERE batch_id > 0) WHERE place <= greatest(1, floor(n * 0.05))"),
    "deletions": deletions(),
    "edge_activation": sql("SELECT src, dst, w, starts AS batch_id FROM lines"),
    "batch_summary": sql("""SELECT batch_id, CAST(sum(inserted) AS BIGINT) AS inserted, CAST(sum(known) AS BIGINT) AS known, CAST(sum(deleted) AS BIGINT) AS deleted, CAST(sum(new_edges) AS BIGINT) AS new_edges FROM (
      SELECT batch_id, 1 AS inserted, CAST(gt_class IS NOT NULL AS INTEGER) AS known, 0 AS deleted, 0 AS new_edges FROM v
      UNION ALL SELECT delete_batch, 0, 0, 1, 0 FROM v WHERE delete_batch IS NOT NULL
      UNION ALL SELECT starts, 0, 0, 0, 1 FROM lines) GROUP BY batch_id"""),
    "vertex_status": sql(status(B)),
    "gt_class": sql("SELECT id, CAST(CASE WHEN id % 5 = 0 THEN -1 WHEN (id % 7) / 6.0 < 0.5 THEN 0 ELSE 1 END AS INTEGER) AS gt_class FROM v"),
    "active_edges": sql("SELECT * FROM act", AT),
    "auto_tau": sql("SELECT CAST(sum(w) AS BIGINT) AS weight, count(*) AS edges, coalesce(round(avg(w), 3), 0.5) AS tau FROM e"),
    "deletion_affected": sql("SELECT id FROM gone", AT),
    "cleaned_edges": sql(f"SELECT * FROM both_ways WHERE id NOT IN (SELECT id FROM v WHERE delete_batch <= {B}) AND nbr NOT IN (SELECT id FROM v WHERE delete_batch <= {B})"),
    "new_edges": sql("SELECT * FROM fresh", AT),
    "subgraph_edge_count": sql("SELECT 2 * count(*) AS directed_edges FROM strong", AT),
    "sparsified_subgraph": sql("SELECT src AS id, dst AS nbr, w FROM strong UNION ALL SELECT dst, src, w FROM strong", AT),
    "insertion_affected": sql("SELECT id FROM near", AT),
    "insertion_affected_all": sql("SELECT id FROM open WHERE id IN (SELECT src FROM fresh UNION SELECT dst FROM fresh UNION SELECT id FROM newv)", AT),
    "connected_components": sql("SELECT id, root FROM comp", comps("", "v", "e")),
    "maintained_components": sql("SELECT id, root FROM comp", AT, comps("", "alive", "act")),
    "component_ids": sql("SELECT id, root, dense_rank() OVER (ORDER BY root) - 1 AS component_id FROM comp", comps("", "v", "e")),
    "singleton_components": sql("SELECT id, id AS root FROM v WHERE id NOT IN (SELECT id FROM both_ways)"),
    "supernode_weights": sql("SELECT root, w0, w1 FROM sides", AT, comps("", "newv", "strong"), weights("")),
    "label_init": sql("SELECT id, f FROM init", AT, comps("", "newv", "strong"), weights(""), initial("")),
    "label_init_isolated": sql(f"SELECT n.id, CAST(coalesce(gt_class * {LABEL}, {LABEL // 2}) AS BIGINT) AS f FROM newv n LEFT JOIN known k ON k.id = n.id WHERE n.id NOT IN (SELECT id FROM adj)", AT),
    "frontier": sql("SELECT id FROM seeds", AT),
    "propagate_step": sql("SELECT id, f FROM one", AT, START, ONE),
    "changed_vertices": sql("SELECT id FROM moved", AT, START, ONE, MOVED),
    "frontier_next": sql("SELECT id FROM open WHERE id IN (FROM moved) OR id IN (SELECT id FROM adj WHERE nbr IN (FROM moved))", AT, START, ONE, MOVED),
    "enforce_gt": sql(f"SELECT a.id, CAST(coalesce(gt_class * {LABEL}, 7) AS BIGINT) AS f FROM alive a", AT),
    "propagate_k": sql(f"SELECT id, f FROM s{SWEEPS}", AT, START, sweeps("", "start", SWEEPS)),
    "full_propagate_step": sql("SELECT id, f FROM one", AT, START, ONE),
    "full_propagation_k": sql(f"SELECT id, f FROM s{SWEEPS}", *FULL),
    "final_status": sql(status(LAST)),
    "predictions": sql(f"SELECT id, CAST(f >= {LABEL // 2} AS INTEGER) AS predicted FROM s{SWEEPS}", *FULL),
    "accuracy": sql(f"""SELECT count(*) AS scored, CAST(coalesce(sum(CAST((f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)), 0) AS BIGINT) AS correct,
      round(coalesce(avg(CAST((f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)), 1.0), 6) AS accuracy
      FROM s{SWEEPS} JOIN v USING (id) WHERE id IN (FROM open)""", *FULL),
    "propagate_converged": sql("SELECT id, f, movers = 0 AS converged FROM \"end\"", AT, START, settled("", "start", cap=SWINGS)),
    "settled_predictions": sql(f"SELECT id, CAST(f >= {LABEL // 2} AS INTEGER) AS predicted, movers = 0 AS converged FROM \"end\"", *REST),
    "settled_accuracy": sql(f"""SELECT count(*) AS scored, CAST(coalesce(sum(CAST((f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)), 0) AS BIGINT) AS correct,
      round(coalesce(avg(CAST((f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)), 1.0), 6) AS accuracy, CAST(max(i) AS INTEGER) AS iterations, max(movers) = 0 AS converged
      FROM "end" JOIN v USING (id) WHERE id IN (FROM open)""", *REST),
    "settled_label_propagation": sql(f"SELECT id, f FROM l{LAST}", *SETTLED),
    "settled_engine_metrics": sql(f"SELECT * EXCLUDE (scored, correct) FROM ({' UNION ALL '.join(SETTLED_METRICS)})", *SETTLED),
    "dynamic_label_propagation": sql(f"SELECT id, f FROM l{LAST}", *ENGINE),
    "engine_metrics": sql(f"SELECT * EXCLUDE (scored, correct, converged) FROM ({' UNION ALL '.join(SETTLED_METRICS)})", *SETTLED),
    "batch_accuracy": sql(f"SELECT batch_id, scored, correct, accuracy FROM ({' UNION ALL '.join(METRICS)})", *ENGINE),
    "batch_tau": sql(f"""SELECT CAST(b AS INTEGER) AS batch_id, CAST(coalesce(sum(w), 0) AS BIGINT) AS weight, count(w) AS edges, coalesce(round(avg(w), 3), 0.5) AS tau
      FROM range({BATCHES}) t(b) LEFT JOIN lines ON starts <= b AND (ends IS NULL OR ends > b) GROUP BY b"""),
    "export_run_predicted": sql(lines("id || ' ' || format('{:.6f}', CAST((f + 50) // 100 AS DOUBLE) / 1000000)", "id", f"SELECT id, coalesce(f, {LABEL // 2}) AS f FROM v LEFT JOIN l{LAST} USING (id)"), *ENGINE),
    "export_run_metrics": sql(f"""SELECT 0 AS place, 'batch,time_ms,accuracy' AS value UNION ALL SELECT row_number() OVER (ORDER BY batch_id),
      batch_id || ',' || format('{{:.2f}}', CAST((batch_id + 1) * 10 AS DOUBLE)) || ',' || format('{{:.6f}}', accuracy) FROM ({' UNION ALL '.join(METRICS)})""", *ENGINE),
    "read_edges": sql("SELECT src, dst, w FROM e"),
    "read_labels": sql("SELECT id, true_label FROM v"),
    "trade_edge_activation": sql("SELECT src, dst, w, starts AS batch_id FROM lines", graph=TRADE),
    "trade_propagate_step": sql("SELECT id, f FROM one", AT, START, ONE, graph=TRADE),
    "engine_beside_recompute": sql(f"""SELECT count(*) AS scored, round(coalesce(avg(CAST((l.f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)), 1.0), 6) AS accuracy,
      round(coalesce(avg(CAST((r.f >= {LABEL // 2}) = (true_label = 1) AS INTEGER)), 1.0), 6) AS full_accuracy, count(*) FILTER ((l.f >= {LABEL // 2}) = (r.f >= {LABEL // 2})) AS same
      FROM v JOIN l{LAST} l USING (id) JOIN rs{SWEEPS} r USING (id) WHERE id IN (FROM ropen)""",
      *ENGINE, state(LAST, "r"), f"rhalf AS MATERIALIZED (SELECT id, CAST({LABEL // 2} AS BIGINT) AS f FROM ralive)", sweeps("r", "rhalf", SWEEPS, full=True)),
    "graph_violations": sql(f"{rules('given', 'v', 'e')} UNION ALL {rules('broken', 'bad_v', 'bad_e')}", BROKEN),
    "run_summary": sql(f"""SELECT count(*) AS batches, round(CAST(sum((batch_id + 1) * 10) AS DOUBLE), 6) AS total_ms, round(avg(accuracy), 6) AS mean_accuracy,
      round(max_by(accuracy, batch_id), 6) AS final_accuracy, round(600.0::DOUBLE / sum((batch_id + 1) * 10), 6) AS speedup FROM ({" UNION ALL ".join(METRICS)})""", *ENGINE),
}
