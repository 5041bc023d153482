"""Queries on gradient scores, the leave-one-out scan, factors, redundancy, joins of predictions, and calibration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweft.operators import annotation as N
from netweft.operators import correlation as C
from netweft.operators import graphs, ranking
from netweft.operators import ontology as O
from netweft.operators import scoring as S
from netweft.operators import statistics as T
from netweft.operators.tables import TASK_ROWS, cut, dealt
from netweft.plans import adapters as A
from netweft.plans.annotation import text
from netweft.plans.expression import LOO
from netweft.plans.network import CLUSTERS, DATASETS, RECURRENCE, brand_clusters, recurrences
from netweft.plans.ontology import OWN_TERMS, DISTANCES, HEAD, TAIL, annotations, paths, predicted_functions
from netweft.plans.registry import ORACLES, query

# Patterns: brand clusters with the edges that three datasets share. A brand has two functions, by its two digits, and is of
# unknown function where the second digit is 5.
FUNCTIONS = "bg AS (SELECT DISTINCT CAST(regexp_extract(p_brand, '[0-9]+') AS INT) AS gene_no FROM part), bf AS (SELECT gene_no, gene_no // 10 AS go_no FROM bg WHERE gene_no % 10 <> 5 UNION ALL SELECT gene_no, 10 + gene_no % 10 FROM bg WHERE gene_no % 10 <> 5)"
PATTERNS = f"{A.EDGES}, {CLUSTERS}, {FUNCTIONS}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 3), pe AS (SELECT a.mcl_id, g1, g2 FROM o JOIN cl a ON a.gene_no = g1 JOIN cl b ON b.gene_no = g2 AND a.mcl_id = b.mcl_id), bo AS (SELECT mcl_id, g1 AS u, g2 AS v FROM pe UNION ALL SELECT mcl_id, g2, g1 FROM pe), bfs AS (SELECT mcl_id, u AS gene_no, u AS v, 0 AS layer FROM bo UNION SELECT bfs.mcl_id, gene_no, bo.v, layer + 1 FROM bfs JOIN bo ON bo.mcl_id = bfs.mcl_id AND bo.u = bfs.v WHERE layer < 5), ly AS (SELECT mcl_id, gene_no, v, min(layer) AS layer FROM bfs GROUP BY ALL)"
CANDIDATES = "nn AS (SELECT mcl_id, gene_no, count(*) FILTER (layer = 1) AS n1, count(*) FILTER (layer = 2) AS n2 FROM ly GROUP BY ALL), cn AS (SELECT mcl_id, ly.gene_no, go_no, count(*) FILTER (layer = 1) AS c1, count(*) FILTER (layer = 2) AS c2 FROM ly JOIN bf ON bf.gene_no = v WHERE layer IN (1, 2) GROUP BY ALL), ca AS (SELECT mcl_id, gene_no, go_no FROM cn JOIN nn USING (mcl_id, gene_no) WHERE c1 >= 1 AND c1 >= 0.1 * n1 AND c2 >= 0 AND c2 >= 0.0 * n2)"
SCORED = "sv AS (SELECT ca.mcl_id, ca.gene_no, ca.go_no, v, layer, CASE WHEN list_contains(fs, ca.go_no) THEN 3 WHEN fs IS NOT NULL THEN -1 ELSE 0 END AS s FROM ca JOIN ly USING (mcl_id, gene_no) LEFT JOIN (SELECT gene_no AS v, list(go_no) AS fs FROM bf GROUP BY gene_no) USING (v))"
BEST = "SELECT mcl_id, gene_no, go_no, round(score, 6) AS score FROM (SELECT *, rank() OVER (PARTITION BY mcl_id, gene_no ORDER BY round(score, 12) DESC) AS r FROM sc) WHERE r = 1"


def brand_functions(spark: SparkSession, d: str) -> DataFrame:
    g = A.table(spark, d, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("int").alias("gene_no")).distinct().where("gene_no % 10 <> 5")
    return g.select("gene_no", F.explode(F.array(F.floor(F.col("gene_no") / 10).cast("int"), 10 + F.col("gene_no") % 10)).alias("go_no"))


def pattern_edges(spark: SparkSession, d: str) -> DataFrame:
    return graphs.cluster_edges(brand_clusters(spark, d), graphs.overlay(A.edges(spark, d), 3).select("g1", "g2")).select("mcl_id", "g1", "g2")


def around(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges of the patterns, layers, functions and candidate functions. The first and the third are small tables read many
    times, each made of all line items or parts once."""
    e, f = cut(pattern_edges(spark, d), "pattern-edges"), cut(brand_functions(spark, d), "functions")
    near = S.layers(e, 5)
    return e, near, f, S.candidates(near, f, 1, 0.1, 0, 0.0)


def best(scores: DataFrame) -> DataFrame:
    return S.best_functions(scores).select("mcl_id", "gene_no", "go_no", F.round("score", 6).alias("score"))


@query("t11_layer_gradient", f"WITH RECURSIVE {PATTERNS}, {CANDIDATES}, {SCORED}, sc AS (SELECT mcl_id, gene_no, go_no, sum(t / (power(n, 0.8) * power(2 * layer, 2))) AS score FROM (SELECT mcl_id, gene_no, go_no, layer, sum(s) AS t, count(*) AS n FROM sv WHERE layer >= 1 GROUP BY ALL) GROUP BY ALL) {BEST}")
def layer_gradient(spark: SparkSession, d: str) -> DataFrame:
    _, near, f, chosen = around(spark, d)
    return best(S.layer_gradient(near, chosen, f))


EDGE_SCORES = """es AS (SELECT x.mcl_id, x.gene_no, x.go_no, CASE WHEN least(x.layer, y.layer) = 0 THEN 2 * greatest(x.layer, y.layer) - 1 ELSE x.layer + y.layer END AS key, CASE WHEN x.layer > 0 THEN x.s ELSE 0 END + CASE WHEN y.layer > 0 THEN y.s ELSE 0 END AS s, x.layer > 0 AND y.layer > 0 AND x.s = 3 AND y.s = -1 AS mixed
FROM pe JOIN sv x ON x.mcl_id = pe.mcl_id AND x.v = g1 JOIN sv y ON y.mcl_id = pe.mcl_id AND y.gene_no = x.gene_no AND y.go_no = x.go_no AND y.v = g2),
ln AS (SELECT mcl_id, gene_no, layer, count(*) AS n FROM ly GROUP BY ALL), de AS (SELECT a.mcl_id, a.gene_no, 2 * a.layer - 1 AS key, power(a.n * b.n, CASE WHEN a.layer = 1 THEN 0.6 ELSE 0.8 END) * power(2 * a.layer - 1, 2) AS w FROM ln a JOIN ln b ON b.mcl_id = a.mcl_id AND b.gene_no = a.gene_no AND b.layer = a.layer - 1
UNION ALL SELECT mcl_id, gene_no, 2 * layer, power(n * (n - 1) / 2, 0.8) * power(2 * layer, 2) FROM ln WHERE layer >= 1 AND n > 1)"""


@query("t11_edge_gradient", f"WITH RECURSIVE {PATTERNS}, {CANDIDATES}, {SCORED}, {EDGE_SCORES}, sc AS (SELECT mcl_id, gene_no, go_no, sum(s / w) AS score FROM es JOIN de USING (mcl_id, gene_no, key) GROUP BY ALL) {BEST}")
def edge_gradient(spark: SparkSession, d: str) -> DataFrame:
    e, near, f, chosen = around(spark, d)
    return best(S.edge_gradient(e, near, chosen, f))


WEIGHTED_SCORES = EDGE_SCORES.replace("SELECT x.mcl_id, x.gene_no, x.go_no,", "SELECT pe.g1, pe.g2, x.mcl_id, x.gene_no, x.go_no,") + ", ew AS (SELECT g1, g2, log10(1 + count(*)) AS lw FROM edge GROUP BY g1, g2)"


@query("t11_weighted_edge_gradient", f"WITH RECURSIVE {PATTERNS}, {CANDIDATES}, {SCORED}, {WEIGHTED_SCORES}, sc AS (SELECT mcl_id, gene_no, go_no, sum(s * lw / w) AS score FROM es JOIN de USING (mcl_id, gene_no, key) JOIN ew USING (g1, g2) GROUP BY ALL) {BEST}")
def weighted_edge_gradient(spark: SparkSession, d: str) -> DataFrame:
    """Edges count by the p-value of the dataset number that they occur in, 1 / (1 + number)."""
    e, near, f, chosen = around(spark, d)
    p = graphs.overlay(A.edges(spark, d)).select("g1", "g2", (1 / (1 + F.col("recurrence"))).alias("p"))
    return best(S.edge_gradient(e.join(p, ["g1", "g2"]), near, chosen, f, p_value="p"))


@query("t12_edge_gradient_unmixed", f"WITH RECURSIVE {PATTERNS}, {CANDIDATES}, {SCORED}, {EDGE_SCORES}, sc AS (SELECT mcl_id, gene_no, go_no, sum(CASE WHEN mixed THEN 0 ELSE s / w END) AS score FROM es JOIN de USING (mcl_id, gene_no, key) GROUP BY ALL) {BEST}")
def edge_gradient_unmixed(spark: SparkSession, d: str) -> DataFrame:
    e, near, f, chosen = around(spark, d)
    return best(S.edge_gradient(e, near, chosen, f, skip_mixed=True))


@query("t12_vertex_gradient", f"WITH RECURSIVE {PATTERNS}, {CANDIDATES}, {SCORED}, sc AS (SELECT mcl_id, gene_no, go_no, sum(s / power(layer, 4)) AS score FROM sv WHERE layer >= 1 GROUP BY ALL) {BEST}")
def vertex_gradient(spark: SparkSession, d: str) -> DataFrame:
    _, near, f, chosen = around(spark, d)
    return best(S.vertex_gradient(near, chosen, f))


SCAN = f"""{HEAD}, {A.ASSOC}, {A.MEMBERS}, kn AS (SELECT DISTINCT gene_no FROM assoc), ow AS (SELECT mem.*, (kn.gene_no IS NOT NULL)::INT AS known FROM mem LEFT JOIN kn USING (gene_no)), si AS (SELECT mcl_id, count(*) AS k0, sum(known)::BIGINT AS known0 FROM ow GROUP BY mcl_id),
lo AS (SELECT mcl_id, go_no, count(*) AS x0 FROM mem JOIN assoc USING (gene_no) GROUP BY ALL), mm AS (SELECT go_no, count(DISTINCT gene_no) AS m0 FROM assoc GROUP BY go_no),
lf AS (SELECT mcl_id, count(*) AS functions FROM lo GROUP BY mcl_id), al AS (SELECT mcl_id, gene_no, count(*) AS gone FROM mem JOIN assoc USING (gene_no) JOIN lo USING (mcl_id, go_no) WHERE x0 = 1 GROUP BY ALL),
ea AS (SELECT ow.mcl_id, ow.gene_no, lo.go_no, x0 - (a.gene_no IS NOT NULL)::INT AS x, m0 - (a.gene_no IS NOT NULL)::INT AS m, k0 - LESS AS k, (SELECT count(*) FROM part) - LESS AS n, known0 - known AS lef, k0 - known0 + known - LESS AS unknown, functions - coalesce(gone, 0) AS functions
FROM lo JOIN mm USING (go_no) JOIN dep ON term = lo.go_no JOIN ow USING (mcl_id) JOIN si USING (mcl_id) JOIN lf USING (mcl_id) LEFT JOIN al ON al.mcl_id = ow.mcl_id AND al.gene_no = ow.gene_no LEFT JOIN assoc a ON a.gene_no = ow.gene_no AND a.go_no = lo.go_no WHERE x0 >= 3 AND m0 >= 5 AND depth >= 2),
pp AS (SELECT mcl_id, gene_no, go_no, round({TAIL} * FACTOR, 9) AS p, CASE WHEN k > 0 THEN unknown / k ELSE 0 END AS unknown FROM ea WHERE x >= 0.05 * lef)
SELECT mcl_id, gene_no, go_no, round(p, 6) AS p, round(unknown, 6) AS unknown FROM (SELECT *, rank() OVER (PARTITION BY mcl_id, gene_no ORDER BY p) AS r FROM pp) WHERE r = 1"""


def scan(spark: SparkSession, d: str, **how) -> DataFrame:
    found = S.cluster_scan(A.members(spark, d), A.associations(spark, d), O.depths(paths(spark, d)), A.table(spark, d, "part").count(), **how)
    return found.select("mcl_id", "gene_no", "go_no", F.round("p", 6).alias("p"), F.round("unknown", 6).alias("unknown"))


@query("t2_cluster_scan", SCAN.replace("LESS", "1").replace("FACTOR", "1"))
def cluster_scan(spark: SparkSession, d: str) -> DataFrame:
    return scan(spark, d)


@query("t2_cluster_scan_kept_size", SCAN.replace("LESS", "0").replace("FACTOR", "(functions + (unknown > 0)::INT)"))
def cluster_scan_kept(spark: SparkSession, d: str) -> DataFrame:
    """The left-out gene becomes unknown; tails times the number of functions in the cluster."""
    return scan(spark, d, move_left_out=True, bonferroni=True)


SITES = "bs AS (SELECT DISTINCT l_partkey AS gene_no, l_suppkey % 40 AS b FROM lineitem WHERE l_discount >= 0.09)"


def sites(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "lineitem").where("l_discount >= 0.09").select(F.col("l_partkey").alias("gene_no"), (F.col("l_suppkey") % 40).cast("int").alias("b")).distinct()


@query(
    "p13_factor_hits",
    f"""WITH {A.MEMBERS}, {SITES}, k AS (SELECT mcl_id, count(*) AS k FROM mem GROUP BY mcl_id), lo AS (SELECT mcl_id, b, count(*) AS x FROM mem JOIN bs USING (gene_no) GROUP BY ALL), en AS (SELECT mcl_id, b, x, k FROM lo JOIN k USING (mcl_id) WHERE x >= 0.05 * k),
N AS (SELECT count(DISTINCT gene_no) AS n FROM bs), g1 AS (SELECT b, count(*) AS m FROM bs GROUP BY b), g2 AS (SELECT a.b AS b1, c.b AS b2, count(*) AS m FROM bs a JOIN bs c ON a.gene_no = c.gene_no AND a.b < c.b GROUP BY ALL),
pr AS (SELECT mem.mcl_id, a.b AS b1, c.b AS b2, count(*) AS x FROM mem JOIN bs a ON a.gene_no = mem.gene_no JOIN bs c ON c.gene_no = mem.gene_no AND a.b < c.b JOIN en e ON e.mcl_id = mem.mcl_id AND e.b = a.b JOIN en f ON f.mcl_id = mem.mcl_id AND f.b = c.b GROUP BY ALL),
al AS (SELECT mcl_id, b AS b1, NULL::INT AS b2, x, m, k, n FROM en JOIN g1 USING (b), N UNION ALL SELECT mcl_id, b1, b2, x, m, k, n FROM pr JOIN g2 USING (b1, b2) JOIN k USING (mcl_id), N), sc AS (SELECT mcl_id, b1, b2, x, round({TAIL}, 9) AS p FROM al)
SELECT mcl_id, b1, b2, x, round(p, 6) AS p FROM (SELECT *, rank() OVER (PARTITION BY mcl_id, b2 IS NULL ORDER BY p, b1, b2) AS r FROM sc WHERE p <= 0.2) WHERE r <= 5""",
)
def factor_hits(spark: SparkSession, d: str) -> DataFrame:
    return S.factor_hits(A.members(spark, d), sites(spark, d), 0.05, 0.2).withColumn("p", F.round("p", 6))


FOLD = "list_reduce(list_transform(g, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda s: s % x[1] = 0 OR x[1] % s = 0)) > 0 THEN acc ELSE list_concat(acc, x) END)"


@query("o14_related_predictions", f"WITH {A.PREDICTIONS}, f AS (SELECT gene_no, go_no, min(p_gene_id) AS pos FROM pred GROUP BY ALL), l AS (SELECT gene_no, list(go_no ORDER BY pos, go_no) AS g FROM f GROUP BY gene_no), s AS (SELECT gene_no, {FOLD} AS sources FROM l) SELECT gene_no, go_no, list_filter(sources, lambda s: s % go_no = 0 OR go_no % s = 0)[1] AS source FROM f JOIN s USING (gene_no)")
def related_predictions(spark: SparkSession, d: str) -> DataFrame:
    return S.collapse_related(A.predictions(spark, d), O.closure(paths(spark, d)), "gene_no", "p_gene_id")


@query("o17_related_functions", f"WITH {A.PREDICTIONS}, f AS (SELECT go_no, count(*) FILTER (is_correct = 1) AS c, count(*) FILTER (is_correct >= 0) AS k FROM pred GROUP BY go_no), l AS (SELECT list(go_no ORDER BY go_no DESC) AS g FROM f), s AS (SELECT {FOLD} AS sources FROM l), m AS (SELECT list_filter(sources, lambda s: s % go_no = 0 OR go_no % s = 0)[1] AS source, c, k FROM f, s) SELECT source, count(*) AS functions, sum(c)::BIGINT AS correct, sum(k)::BIGINT AS known FROM m GROUP BY source")
def related_functions(spark: SparkSession, d: str) -> DataFrame:
    """Functions in descending order, related ones put together, and their counts added up."""
    p = A.predictions(spark, d)
    counts = p.groupBy("go_no").agg(F.count_if(F.col("is_correct") == 1).alias("c"), F.count_if(F.col("is_correct") >= 0).alias("k"))
    one = counts.select(F.lit(1).alias("all"), "go_no", (-F.col("go_no")).alias("at"))
    groups = S.collapse_related(one, O.closure(paths(spark, d)), "all", "at")
    return groups.join(counts, "go_no").groupBy("source").agg(F.count("*").alias("functions"), F.sum("c").alias("correct"), F.sum("k").alias("known"))


@query(
    "o15_topologies",
    f"""WITH RECURSIVE {PATTERNS}, nb AS (SELECT gene_no, mcl_id, v FROM ly WHERE layer = 1), n AS (SELECT gene_no, mcl_id, count(*) AS n FROM nb GROUP BY ALL), al AS (SELECT a.gene_no, a.mcl_id AS m1, b.mcl_id AS m2 FROM nb a JOIN nb b ON a.gene_no = b.gene_no AND a.v = b.v AND a.mcl_id <> b.mcl_id JOIN n x ON x.gene_no = a.gene_no AND x.mcl_id = a.mcl_id JOIN n y ON y.gene_no = b.gene_no AND y.mcl_id = b.mcl_id GROUP BY ALL HAVING count(*) >= 0.7 * least(any_value(x.n), any_value(y.n))),
re AS (SELECT gene_no, mcl_id AS s, mcl_id AS m FROM n UNION SELECT re.gene_no, s, m2 FROM re JOIN al ON al.gene_no = re.gene_no AND al.m1 = re.m) SELECT gene_no, s AS mcl_id, min(m) AS topology FROM re GROUP BY gene_no, s""",
)
def topologies(spark: SparkSession, d: str) -> DataFrame:
    return S.topologies(S.layers(pattern_edges(spark, d), 5), 1, 0.7)


@query("o16_topologies_of_a_gene", f"{ORACLES['o15_topologies'].replace('SELECT gene_no, s AS mcl_id, min(m) AS topology FROM re GROUP BY gene_no, s', 'SELECT gene_no, count(DISTINCT t) AS topologies FROM (SELECT gene_no, s, min(m) AS t FROM re GROUP BY gene_no, s) GROUP BY gene_no')}")
def topology_counts(spark: SparkSession, d: str) -> DataFrame:
    return topologies(spark, d).groupBy("gene_no").agg(F.countDistinct("topology").alias("topologies"))


@query("o18_merged_contexts")
def merged_contexts(spark: SparkSession, d: str) -> DataFrame:
    """All functions predicted for a gene, of known correctness or not, merged where the genes of their clusters are alike."""
    p = A.predictions(spark, d).select("gene_no", "go_no", "mcl_id", "is_correct")
    p = dealt(p, "gene_no", rows=p.count(), within=TASK_ROWS // 5).distinct()  # dealt by gene once, for this and for all that follows
    # a cluster's genes as one array, so that they aren't joined one by one to every prediction
    m = A.members(spark, d).join(p.select("mcl_id").distinct(), "mcl_id", "left_semi").groupBy("mcl_id").agg(F.collect_set("gene_no").alias("c"))
    one = p.join(m, "mcl_id").groupBy("gene_no", "go_no").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("context"), F.min("is_correct").alias("is_correct"))
    found = S.merge_contexts(one, 0.5)
    return found.select("gene_no", "go_no", text(F.col("members")).alias("members"), F.size("context").alias("genes"), "is_correct")


@query("o4_term_distances", f"{HEAD}, {DISTANCES}, {OWN_TERMS}, q AS (SELECT DISTINCT a.go_no AS a, b.go_no AS b FROM an a JOIN an b USING (probe)) SELECT a, b, CASE WHEN a = b THEN 0 ELSE shorter_leg END AS distance FROM q LEFT JOIN ds ON t1 = least(a, b) AND t2 = greatest(a, b)")
def term_distances(spark: SparkSession, d: str) -> DataFrame:
    """Distances of the pairs of functions that a gene's annotations make, in either order."""
    an = annotations(spark, d)
    pairs = an.select("probe", F.col("go_no").alias("a")).join(an.select("probe", F.col("go_no").alias("b")), "probe").select("a", "b").distinct()
    return O.distance_of(pairs, paths(spark, d)).select("a", "b", F.col("distance").cast("long").alias("distance"))


OLDER = f"{OWN_TERMS}, kn AS (SELECT probe AS gene_no, go_no AS own FROM an WHERE probe % 4 <> 0), pd AS (SELECT DISTINCT l_orderkey AS gene_no, CAST(l_quantity AS INT) AS go_no FROM lineitem)"


@query(
    "o13_judged_by_relation",
    f"""{HEAD}, {OLDER}, j AS (SELECT pd.gene_no, pd.go_no, own, EXISTS (SELECT 1 FROM clo WHERE ancestor = pd.go_no AND term = own) AS below, EXISTS (SELECT 1 FROM t2t WHERE parent = pd.go_no AND child = own OR parent = own AND child = pd.go_no) OR EXISTS (SELECT 1 FROM t2t x JOIN t2t y USING (parent) WHERE x.child = pd.go_no AND y.child = own) AS beside FROM pd LEFT JOIN kn USING (gene_no))
SELECT gene_no, go_no, CASE WHEN count(own) = 0 THEN -1 ELSE bool_or(below)::INT END AS is_correct, CASE WHEN count(own) = 0 THEN -1 ELSE bool_or(below OR beside)::INT END AS is_correct_l1 FROM j GROUP BY ALL""",
)
def judged_by_relation(spark: SparkSession, d: str) -> DataFrame:
    """Correct if a known function is the predicted one or below it; on the next level also if it is its parent, child or sibling."""
    e = A.term_edges(spark, d)
    below = O.closure(paths(spark, d)).select(F.col("ancestor").alias("go_no"), F.col("term").alias("own"), F.lit(True).alias("below"))
    sibling = e.select("parent", F.col("child").alias("go_no")).join(e.select("parent", F.col("child").alias("own")), "parent").select("go_no", "own")
    beside = e.select(F.col("parent").alias("go_no"), F.col("child").alias("own")).unionByName(e.select(F.col("child").alias("go_no"), F.col("parent").alias("own"))).unionByName(sibling).distinct().withColumn("beside", F.lit(True))
    known = annotations(spark, d).where("probe % 4 <> 0").select(F.col("probe").alias("gene_no"), F.col("go_no").cast("int").alias("own"))
    related = cut(below.join(beside, ["go_no", "own"], "full"), "related")  # of two terms, once
    j = predicted_functions(spark, d).join(known, "gene_no", "left").join(related, ["go_no", "own"], "left")
    flag = lambda c: F.when(F.count("own") == 0, -1).otherwise(F.coalesce(F.bool_or(c), F.lit(False)).cast("int"))
    return j.groupBy("gene_no", "go_no").agg(flag(F.col("below")).alias("is_correct"), flag(F.coalesce(F.col("below"), F.col("beside"))).alias("is_correct_l1"))


@query(
    "a32_graded_correctness",
    f"""{HEAD}, {DISTANCES}, {OLDER}, j AS (SELECT p.gene_no, p.go_no, CASE WHEN p.go_no = own THEN [own] ELSE ancestors END AS anc, own FROM pd p JOIN kn USING (gene_no) LEFT JOIN ds ON t1 = least(p.go_no, own) AND t2 = greatest(p.go_no, own)),
g AS (SELECT gene_no, go_no, max(depth) AS deepest FROM (SELECT gene_no, go_no, unnest(anc) AS a FROM j) JOIN dep ON term = a GROUP BY ALL)
SELECT pd.gene_no, pd.go_no, round(CASE WHEN deepest >= 2 THEN (deepest - 2 + 1) / (dep.depth - 2 + 1) ELSE 0 END, 6) AS degree FROM (SELECT DISTINCT gene_no, go_no FROM j) pd LEFT JOIN g USING (gene_no, go_no) JOIN dep ON term = pd.go_no WHERE depth >= 2""",
)
def graded(spark: SparkSession, d: str) -> DataFrame:
    """Depth of the first common ancestor over that of the predicted term, both from the cut of 2 on; 0 where wrong."""
    p = paths(spark, d)
    depth = O.depths(p)
    known = annotations(spark, d).where("probe % 4 <> 0").withColumnRenamed("probe", "gene_no")
    judged = O.judge(predicted_functions(spark, d), known, p, 2).where("is_correct_lca >= 0")
    own = judged.join(depth.select(F.col("term").alias("go_no"), "depth"), "go_no").join(depth.select(F.col("term").alias("first"), F.col("depth").alias("deepest")), F.col("first") == F.get("lca", F.lit(0)), "left")
    degree = F.when(F.col("is_correct_lca") == 1, (F.col("deepest") - 1) / (F.col("depth") - 1)).otherwise(0.0)
    return own.where("depth >= 2").select("gene_no", "go_no", F.round(degree, 6).alias("degree"))


@query("a27_confirmed_later", f"{HEAD}, {OLDER}, wr AS (SELECT pd.* FROM pd WHERE EXISTS (SELECT 1 FROM an WHERE probe = pd.gene_no) AND NOT EXISTS (SELECT 1 FROM kn JOIN clo ON term = own WHERE kn.gene_no = pd.gene_no AND ancestor = pd.go_no)) SELECT go_no, count(*) AS wrong, count(*) FILTER (EXISTS (SELECT 1 FROM an JOIN clo ON term = an.go_no WHERE probe = wr.gene_no AND ancestor = wr.go_no)) AS confirmed FROM wr GROUP BY go_no")
def confirmed_later(spark: SparkSession, d: str) -> DataFrame:
    """Predictions that older annotations make wrong, and those of them that all annotations confirm, by function."""
    closed = O.closure(paths(spark, d))
    an = annotations(spark, d)
    true = lambda rows: rows.select(F.col("probe").alias("gene_no"), F.col("go_no").alias("term")).join(closed, "term").select("gene_no", F.col("ancestor").alias("go_no")).distinct()
    predicted = A.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("gene_no"), F.col("l_quantity").cast("int").alias("go_no")).distinct()
    wrong = predicted.join(an.select(F.col("probe").alias("gene_no")).distinct(), "gene_no", "left_semi").join(true(an.where("probe % 4 <> 0")), ["gene_no", "go_no"], "left_anti")
    return wrong.join(true(an).withColumn("ok", F.lit(1)), ["gene_no", "go_no"], "left").groupBy("go_no").agg(F.count("*").alias("wrong"), F.count("ok").alias("confirmed"))


@query("p12_recurrence_filter", f"WITH {RECURRENCE}, oc AS (SELECT g1, g2, count(*) AS occ FROM edge GROUP BY g1, g2), pb AS (SELECT mcl_id, sum(ln(occ / {DATASETS})) AS lp FROM ce JOIN oc USING (g1, g2) GROUP BY mcl_id), rr AS (SELECT mcl_id, count(*) FILTER (r >= 0.5) AS x FROM rec GROUP BY mcl_id) SELECT mcl_id, x, round(lp, 5) AS log_p FROM pb JOIN rr USING (mcl_id) WHERE x = 0 OR list_sum(list_transform(range(x, {DATASETS} + 1), lambda i: exp(lgamma({DATASETS} + 1) - lgamma(i + 1) - lgamma({DATASETS} - i + 1) + i * lp + ({DATASETS} - i) * ln(1 - exp(lp))))) <= 0.05 AND x > 0")
def recurrence_filter(spark: SparkSession, d: str) -> DataFrame:
    """Clusters that recur in x datasets, with x unlikely where every edge occurs by itself: the tail is compared with 0.05."""
    e = A.edges(spark, d)
    occurrence = graphs.overlay(e)
    inside = graphs.cluster_edges(brand_clusters(spark, d), occurrence)
    lp = inside.groupBy("mcl_id").agg(F.sum(F.log(F.col("recurrence") / DATASETS)).alias("lp"))
    x = recurrences(spark, d).groupBy("mcl_id").agg(F.count_if(F.col("r") >= 0.5).alias("x"))
    tail = T.binomial_log_tail(F.col("x"), F.lit(DATASETS), F.exp("lp"))
    return lp.join(x, "mcl_id").where((F.col("x") == 0) | (tail <= F.log(F.lit(0.05)))).select("mcl_id", "x", F.round("lp", 5).alias("log_p"))


@query("a5_original_connectivity", f"WITH {RECURRENCE}, v AS (SELECT mcl_id, count(*) AS v FROM cl GROUP BY mcl_id) SELECT mcl_id, round(avg(hits / (v * (v - 1) / 2)), 6) AS connectivity FROM rec JOIN v USING (mcl_id) WHERE r >= 0.1 AND v > 1 GROUP BY mcl_id")
def original_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Density of a cluster's edges in each dataset where it recurs, averaged over these."""
    v = brand_clusters(spark, d).groupBy("mcl_id").agg(F.count("*").alias("v")).where("v > 1")
    each = recurrences(spark, d).where("r >= 0.1").join(v, "mcl_id")
    return each.groupBy("mcl_id").agg(F.round(F.avg(F.col("hits") / (F.col("v") * (F.col("v") - 1) / 2)), 6).alias("connectivity"))


@query("a6_top_connectivity", f"WITH {RECURRENCE}, v AS (SELECT mcl_id, count(*) AS v FROM cl GROUP BY mcl_id), c AS (SELECT mcl_id, list(hits / (v * (v - 1) / 2) ORDER BY hits DESC) AS c FROM rec JOIN v USING (mcl_id) WHERE v > 1 GROUP BY mcl_id) SELECT mcl_id, round(list_sum(c[1:5]) / 5, 6) AS top, round(list_sum(c) / {DATASETS}, 6) AS overall FROM c")
def top_connectivity(spark: SparkSession, d: str) -> DataFrame:
    """Mean density over the five datasets where it is highest (absent ones count 0), and over all."""
    v = brand_clusters(spark, d).groupBy("mcl_id").agg(F.count("*").alias("v")).where("v > 1")
    each = recurrences(spark, d).join(v, "mcl_id").withColumn("c", F.col("hits") / (F.col("v") * (F.col("v") - 1) / 2))
    lists = each.groupBy("mcl_id").agg(F.sort_array(F.collect_list("c"), asc=False).alias("c"))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    return lists.select("mcl_id", F.round(total(F.slice("c", 1, 5)) / 5, 6).alias("top"), F.round(total(F.col("c")) / DATASETS, 6).alias("overall"))


BISECT = """n AS (SELECT count(*) AS n FROM q), s AS (SELECT row_number() OVER w - 1 AS i, score, sum(c) OVER (ORDER BY score, c, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) / count(*) OVER (ORDER BY score, c, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM q WINDOW w AS (ORDER BY score, c, id)),
b AS (SELECT 0 AS step, 0::BIGINT AS lo, n AS up, n // 2 AS i FROM n UNION ALL SELECT step + 1, CASE WHEN a >= 0.335 THEN lo ELSE b.i END, CASE WHEN a >= 0.335 THEN b.i ELSE up END, CASE WHEN a >= 0.335 THEN (b.i + lo) // 2 ELSE (up + b.i) // 2 END FROM b JOIN s USING (i) WHERE abs(a - 0.335) > 0.001 AND CASE WHEN a >= 0.335 THEN (b.i + lo) // 2 ELSE (up + b.i) // 2 END <> b.i)"""


@query("w10_bisected_cut_off", f"WITH RECURSIVE {A.PREDICTIONS}, q AS (SELECT score, is_correct AS c, p_gene_id AS id FROM pred WHERE is_correct >= 0), {BISECT} SELECT score AS cut_off FROM s WHERE i = (SELECT i FROM b ORDER BY step DESC LIMIT 1)")
def bisected_cut_off(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d).where("is_correct >= 0").select("score", F.col("is_correct").alias("c"), F.col("p_gene_id").alias("id"))
    return spark.createDataFrame([(ranking.bisected_cut_off(p, "score", "c", "id", 0.335),)], "cut_off double")


@query("c3_counts_by_cut_off", f"WITH {LOO} SELECT dataset_no, count(*) FILTER (r >= 0.6) AS fixed, " + ", ".join(f"count(*) FILTER (r >= {C.correlation_cut_off(p, 5)!r}) AS {n}" for n, p in (("p05", 0.05), ("p025", 0.025), ("p01", 0.01))) + " FROM m WHERE r <= 1 GROUP BY dataset_no")
def counts_by_cut_off(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a dataset at the fixed correlation and at three p-values, counted in the kernel."""
    import numpy as np

    cuts = {"fixed": 0.6} | {n: C.correlation_cut_off(p, 5) for n, p in (("p05", 0.05), ("p025", 0.025), ("p01", 0.01))}
    order = sorted(cuts.values())
    counts = C.pair_counts(A.expression(spark, d), "min_cor", lambda r: np.where(np.isnan(r) | (r > 1), np.nan, np.searchsorted(order, r, "right")))
    reached = lambda c: F.coalesce(F.sum(F.when(F.col("bin") > order.index(c), F.col("pairs"))), F.lit(0))
    return counts.groupBy("dataset_no").agg(*[reached(c).alias(n) for n, c in cuts.items()])


# joins of predictions, patterns and sites

GOOD = "gp AS (SELECT arg_min(p_gene_id, (-score, p_gene_id)) AS p_gene_id FROM pred GROUP BY gene_no, go_no)"


def good(spark: SparkSession, d: str) -> DataFrame:
    return ranking.best_per_key(A.predictions(spark, d), ["gene_no", "go_no"], [F.desc("score"), "p_gene_id"]).select("p_gene_id")


@query("j1_selected_predictions", f"WITH {A.PREDICTIONS}, {GOOD} SELECT go_no, count(*) AS n, count(*) FILTER (is_correct = 1) AS correct FROM pred JOIN gp USING (p_gene_id) GROUP BY go_no")
def selected_predictions(spark: SparkSession, d: str) -> DataFrame:
    p = A.predictions(spark, d).join(good(spark, d), "p_gene_id")
    return p.groupBy("go_no").agg(F.count("*").alias("n"), F.count_if(F.col("is_correct") == 1).alias("correct"))


@query("j2_predictions_with_clusters", f"WITH {A.PREDICTIONS}, {GOOD}, {A.MEMBERS}, c AS (SELECT mcl_id, count(*) AS size FROM mem GROUP BY mcl_id) SELECT mcl_id, size, count(*) AS predictions, round(avg(score), 4) AS score FROM pred JOIN gp USING (p_gene_id) JOIN c USING (mcl_id) GROUP BY mcl_id, size")
def predictions_with_clusters(spark: SparkSession, d: str) -> DataFrame:
    c = A.members(spark, d).groupBy("mcl_id").agg(F.count("*").alias("size"))
    p = A.predictions(spark, d).join(good(spark, d), "p_gene_id").join(c, "mcl_id")
    return p.groupBy("mcl_id", "size").agg(F.count("*").alias("predictions"), F.round(F.avg("score"), 4).alias("score"))


@query("j3_good_patterns", f"WITH {A.MEMBERS}, {A.PREDICTIONS}, ok AS (SELECT mcl_id FROM pred GROUP BY mcl_id HAVING count(*) FILTER (is_correct = 1) >= 0.25 * count(*)), st AS (SELECT DISTINCT s_suppkey AS mcl_id, s_nationkey AS bs FROM supplier) SELECT mcl_id, bs, count(*) AS genes FROM mem JOIN ok USING (mcl_id) JOIN st USING (mcl_id) GROUP BY ALL")
def good_patterns(spark: SparkSession, d: str) -> DataFrame:
    ok = A.predictions(spark, d).groupBy("mcl_id").agg((F.count_if(F.col("is_correct") == 1) >= 0.25 * F.count("*")).alias("ok")).where("ok").select("mcl_id")
    st = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("mcl_id"), F.col("s_nationkey").alias("bs")).distinct()
    return A.members(spark, d).join(ok, "mcl_id").join(st, "mcl_id").groupBy("mcl_id", "bs").agg(F.count("*").alias("genes"))


@query("j4_grandparents", f"WITH {A.TERMS} SELECT x.parent AS top, y.child AS bottom, count(*) AS ways FROM t2t x JOIN t2t y ON x.child = y.parent GROUP BY ALL")
def grandparents(spark: SparkSession, d: str) -> DataFrame:
    e = A.term_edges(spark, d)
    return e.select(F.col("parent").alias("top"), F.col("child").alias("mid")).join(e.select(F.col("parent").alias("mid"), F.col("child").alias("bottom")), "mid").groupBy("top", "bottom").agg(F.count("*").alias("ways"))


@query("j6_members_of_arrays", f"WITH {A.MEMBERS}, {A.PREDICTIONS}, c AS (SELECT mcl_id, list(gene_no) AS genes FROM mem GROUP BY mcl_id) SELECT mcl_id, count(*) AS predictions FROM (SELECT mcl_id, unnest(genes) AS gene_no FROM c) JOIN (SELECT gene_no FROM pred WHERE is_correct = 1) USING (gene_no) GROUP BY mcl_id")
def members_of_arrays(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of genes that a cluster's gene array holds: the array is exploded, then joined by equality."""
    arrays = A.members(spark, d).groupBy("mcl_id").agg(F.collect_list("gene_no").alias("genes"))
    p = A.predictions(spark, d).where("is_correct = 1").select("gene_no")
    return arrays.select("mcl_id", F.explode("genes").alias("gene_no")).join(p, "gene_no").groupBy("mcl_id").agg(F.count("*").alias("predictions"))


@query("j7_sites_promoters_matrices", "SELECT s_nationkey AS matrix, p_brand AS gene, count(*) AS hits, max(l_extendedprice) AS best FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity >= 45 GROUP BY ALL")
def sites_promoters_matrices(spark: SparkSession, d: str) -> DataFrame:
    site = A.table(spark, d, "lineitem").where("l_quantity >= 45").select("l_partkey", "l_suppkey", "l_extendedprice")
    promoter = A.table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("gene"))
    matrix = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("matrix"))
    return site.join(promoter, "l_partkey").join(matrix, "l_suppkey").groupBy("matrix", "gene").agg(F.count("*").alias("hits"), F.max("l_extendedprice").alias("best"))


@query("j9_looked_up_functions", f"WITH {A.PREDICTIONS}, {A.ASSOC} SELECT gene_no, count(*) AS n, count(DISTINCT a.go_no) AS own FROM pred JOIN assoc a USING (gene_no) GROUP BY gene_no")
def looked_up(spark: SparkSession, d: str) -> DataFrame:
    """A dictionary from genes to functions, probed by every prediction; adaptive execution broadcasts it while it is small."""
    a = A.associations(spark, d).withColumnRenamed("go_no", "own")
    return A.predictions(spark, d).select("gene_no").join(a, "gene_no").groupBy("gene_no").agg(F.count("*").alias("n"), F.countDistinct("own").alias("own"))


@query("f2_composed_maps", "SELECT c_custkey AS a, n_regionkey AS c FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier)")
def composed_maps(spark: SparkSession, d: str) -> DataFrame:
    """a -> b -> c for the b that the second map has."""
    first = A.table(spark, d, "customer").select(F.col("c_custkey").alias("a"), F.col("c_nationkey").alias("b"))
    have = A.table(spark, d, "supplier").select(F.col("s_nationkey").alias("b")).distinct()
    second = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("c")).join(have, "b", "left_semi")
    return first.join(second, "b").select("a", "c")


LINKED = f"{A.ASSOC}, {A.GENES}, lk AS (SELECT DISTINCT a.l_partkey AS g1, b.l_partkey AS g2 FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey)"


@query("t19_homogeneous_share", f"WITH {LINKED}, kk AS (SELECT count(*) AS n FROM lk JOIN gene x ON x.gene_no = g1 JOIN gene y ON y.gene_no = g2 WHERE x.known AND y.known) SELECT a.go_no, round(100.0 * count(*) / any_value(n), 6) AS share FROM lk JOIN assoc a ON a.gene_no = g1 JOIN assoc b ON b.gene_no = g2 AND a.go_no = b.go_no, kk GROUP BY a.go_no")
def homogeneous_share(spark: SparkSession, d: str) -> DataFrame:
    """Percentage of the edges between known genes whose ends share the function."""
    from netweft.plans.annotation import part_links

    classes = N.edge_classes(part_links(spark, d), A.associations(spark, d), A.genes(spark, d)).where("c00 > 0")
    return classes.select("go_no", F.round(100.0 * F.col("c00") / (F.col("c00") + F.col("c01") + F.col("c11")), 6).alias("share"))


@query("t22_edges_by_degree", f"WITH {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 2), dg AS (SELECT g, count(*) AS degree FROM (SELECT g1 AS g FROM o UNION ALL SELECT g2 FROM o) GROUP BY g) SELECT degree, round(100.0 * sum(degree) / (SELECT 2 * count(*) FROM o), 6) AS share FROM dg GROUP BY degree")
def edges_by_degree(spark: SparkSession, d: str) -> DataFrame:
    """Percentage of all edge ends that vertices of a degree hold."""
    dist = graphs.degree_distribution(graphs.overlay(A.edges(spark, d), 2)).withColumn("ends", F.col("degree") * F.col("vertices"))
    return dist.crossJoin(dist.agg(F.sum("ends").alias("all"))).select("degree", F.round(100.0 * F.col("ends") / F.col("all"), 6).alias("share"))


@query("w18_random_subgraph", f"WITH {A.EDGES}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2), g AS (SELECT g1 AS g FROM o UNION SELECT g2 FROM o), s AS (SELECT g FROM g ORDER BY md5('7:' || g), g LIMIT 10) SELECT g1, g2 FROM o WHERE g1 IN (FROM s) AND g2 IN (FROM s)")
def random_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """The edges among ten vertices that a seeded hash chooses (a sampling operator)."""
    o = graphs.overlay(A.edges(spark, d)).select("g1", "g2")
    s = graphs.endpoints(o).distinct().orderBy(F.md5(F.concat(F.lit("7:"), F.col("gene").cast("string"))), "gene").limit(10)
    return o.join(s.withColumnRenamed("gene", "g1"), "g1", "left_semi").join(s.withColumnRenamed("gene", "g2"), "g2", "left_semi").select("g1", "g2")


@query("t20_sampled_graph_overlap", f"WITH {A.EDGES}, hc AS (SELECT a.dataset_no, a.gene AS g1, b.gene AS g2, count(*) AS n FROM lq a JOIN lq b ON a.o = b.o AND a.dataset_no = b.dataset_no AND a.gene < b.gene WHERE a.o % 2 = 0 GROUP BY ALL), he AS (SELECT dataset_no, g1, g2 FROM (SELECT *, row_number() OVER (PARTITION BY dataset_no ORDER BY n DESC, g1, g2) AS r, count(*) OVER (PARTITION BY dataset_no) AS c FROM hc) WHERE r <= CAST(floor(c * 0.2) AS INT)) SELECT e.dataset_no, count(*) AS edges, count(h.g1) AS kept FROM edge e LEFT JOIN he h USING (dataset_no, g1, g2) GROUP BY e.dataset_no")
def sampled_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Edges of each dataset's graph that a graph from half of the observations has too (a sampling operator)."""
    b = A.brand_datasets(spark, d).where("o % 2 = 0")
    half = b.withColumnRenamed("gene", "g1").join(b.withColumnRenamed("gene", "g2"), ["o", "dataset_no"]).where("g1 < g2").groupBy("dataset_no", "g1", "g2").agg(F.count("*").alias("n"))
    kept = ranking.top_share(half, ["dataset_no"], "n", ["g1", "g2"], 0.2).select("dataset_no", "g1", "g2", F.lit(1).alias("k"))
    return A.edges(spark, d).join(kept, ["dataset_no", "g1", "g2"], "left").groupBy("dataset_no").agg(F.count("*").alias("edges"), F.count("k").alias("kept"))


@query("a33_homogeneity_curve", f"WITH {A.EDGES}, tri AS (SELECT x.dataset_no, x.g1 AS a, x.g2 AS b, y.g2 AS c FROM edge x JOIN edge y ON x.dataset_no = y.dataset_no AND x.g1 = y.g1 AND x.g2 < y.g2 JOIN edge z ON z.dataset_no = x.dataset_no AND z.g1 = x.g2 AND z.g2 = y.g2), fr AS (SELECT a, b, c, count(*) AS freq, CASE WHEN a // 10 = b // 10 AND b // 10 = c // 10 THEN 1.0 ELSE 0.0 END AS h FROM tri GROUP BY a, b, c) SELECT freq, count(*) AS cliques, round(avg(h), 6) AS mean, round(avg(h) - 1.645 * stddev_samp(h) / sqrt(count(*)), 6) AS low, round(avg(h) + 1.645 * stddev_samp(h) / sqrt(count(*)), 6) AS high FROM fr GROUP BY freq HAVING count(*) > 1")
def homogeneity_curve(spark: SparkSession, d: str) -> DataFrame:
    """Share of the triangles of a frequency whose three genes have one function, with its 90 percent band."""
    freq = graphs.triangles(A.edges(spark, d), ["dataset_no"]).groupBy("a", "b", "c").agg(F.count("*").alias("freq"))
    f = lambda g: F.floor(F.col(g) / 10)
    h = freq.select("freq", F.when((f("a") == f("b")) & (f("b") == f("c")), 1.0).otherwise(0.0).alias("h"))
    s = h.groupBy("freq").agg(F.count("*").alias("cliques"), F.avg("h").alias("m"), F.stddev_samp("h").alias("sd")).where("cliques > 1")
    band = 1.645 * F.col("sd") / F.sqrt("cliques")
    return s.select("freq", "cliques", F.round("m", 6).alias("mean"), F.round(F.col("m") - band, 6).alias("low"), F.round(F.col("m") + band, 6).alias("high"))


@query("c9_columns_side_by_side", f"WITH {A.EDGE_COUNTS} SELECT g1, g2, " + ", ".join(f"sum(n) FILTER (dataset_no = {i})::BIGINT AS d{i}" for i in range(1, DATASETS + 1)) + " FROM ec GROUP BY g1, g2")
def columns_side_by_side(spark: SparkSession, d: str) -> DataFrame:
    """The edge tables of all datasets as columns of one: an edge has a row if any of them has it."""
    e = A.edge_counts(spark, d)
    return e.groupBy("g1", "g2").agg(*[F.sum(F.when(F.col("dataset_no") == i, F.col("n"))).alias(f"d{i}") for i in range(1, DATASETS + 1)])


@query(
    "g11_second_order_graph",
    f"""WITH {A.EDGES}, {CLUSTERS}, o AS (SELECT g1, g2 FROM edge GROUP BY g1, g2 HAVING count(*) >= 3), ce AS (SELECT a.mcl_id, g1, g2 FROM o JOIN cl a ON a.gene_no = g1 JOIN cl b ON b.gene_no = g2 AND a.mcl_id = b.mcl_id),
p AS (SELECT x.mcl_id, x.g1 AS a1, x.g2 AS a2, y.g1 AS b1, y.g2 AS b2 FROM ce x JOIN ce y ON x.mcl_id = y.mcl_id AND (x.g1, x.g2) < (y.g1, y.g2))
SELECT mcl_id, a1, a2, b1, b2, round(corr(u.n, v.n), 6) AS cor FROM p JOIN edge u ON u.g1 = a1 AND u.g2 = a2 JOIN edge v ON v.g1 = b1 AND v.g2 = b2 AND v.dataset_no = u.dataset_no GROUP BY ALL HAVING count(*) >= 3 AND round(corr(u.n, v.n), 6) BETWEEN 0.5 AND 1""",
)
def second_order_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of a cluster as vertices, linked where their strengths go together over the datasets that have both."""
    e = A.edges(spark, d)
    entries = F.map_from_entries(F.collect_list(F.struct("dataset_no", "n")))
    o = e.groupBy("g1", "g2").agg(entries.alias("m")).where("size(m) >= 3")
    v = o.select("g1", "g2", F.transform(F.sequence(F.lit(1), F.lit(DATASETS)), lambda i: F.try_element_at("m", i).cast("double")).alias("v"))
    inside = graphs.cluster_edges(brand_clusters(spark, d), v)
    x, y = (side.select("mcl_id", "__i", "__j", F.col("g1").alias(f"{k}1"), F.col("g2").alias(f"{k}2"), F.col("v").alias(f"v{k}")) for k, side in zip("ab", graphs.in_blocks(inside, "mcl_id")))
    pairs = x.join(y, ["mcl_id", "__i", "__j"]).where("a1 < b1 OR (a1 = b1 AND a2 < b2)")
    s = C.sums(F.col("va"), F.col("vb"))
    cor = F.round(C.pearson(F.col("va"), F.col("vb")), 6)
    return pairs.withColumns({"n": s["n"], "cor": cor}).where("n >= 3 AND cor BETWEEN 0.5 AND 1").select("mcl_id", "a1", "a2", "b1", "b2", "cor")
