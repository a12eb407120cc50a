"""Queries of the pipeline round the scores: models, batches, training texts, runs, reports and exports, and their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ontospark.functions import prompts as P
from ontospark.functions.text import term_key
from ontospark.operators import classifiers as C
from ontospark.operators import experiments as X
from ontospark.operators import graph as G
from ontospark.operators import metrics as M
from ontospark.operators import models as L
from ontospark.operators import relations as R
from ontospark.operators import similarity as S
from ontospark.operators import weights as W
from ontospark.operators.hierarchy import term_links
from ontospark.operators.order import numbered
from ontospark.plans.reference import _GRAPH, _K, _PAIRS, _TREE, _U, _emb, _groups, _near_graph, _pairs, _r
from ontospark.runtime import table
from ontospark.sources import files

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _u(*parts: str) -> str:
    """The chance of a key that is put together from SQL expressions."""
    return _U.format("concat(" + ", ".join(parts) + ")")


# models

_LETTERS = "list_transform(range(97, 123), lambda c: CAST(length({0}) - length(replace({0}, chr(CAST(c AS INTEGER)), '')) AS DOUBLE))"
_ENCODED = f"""WITH t AS (SELECT row_pos, {_LETTERS.format("substr(lower(term), 1, 12)")} AS v FROM terms_train WHERE term IS NOT NULL),
e AS (SELECT row_pos, list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-12)) AS v FROM t)
"""


@query("encode_terms", _ENCODED + "SELECT row_pos, round(list_sum(v), 6) AS total, round(v[1], 6) AS a, round(v[5], 6) AS e FROM e")
def _(s, d):
    v = table(s, d, "terms_train").filter("term is not null").select("row_pos", L.encode(F.col("term"), L.LetterEncoder, most=12).alias("v"))
    return v.select("row_pos", _r(F.aggregate("v", F.lit(0.0), lambda a, x: a + x)).alias("total"), _r(F.col("v")[0]).alias("a"), _r(F.col("v")[4]).alias("e"))


@query("generate_structured", """WITH t AS (SELECT row_pos, concat('Term?', chr(10), term) AS p, term FROM terms_train WHERE term IS NOT NULL),
w AS (SELECT row_pos, length(p) % 3 <> 0 AS ok, list_sort(list_distinct(list_filter(string_split(term, ' '), lambda x: length(x) > 3))) AS types FROM t)
SELECT row_pos, CASE WHEN ok THEN array_to_string(types, ',') ELSE '' END AS types, CASE WHEN ok THEN 1 ELSE 3 END AS attempts, ok FROM w""")
def _(s, d):
    t = table(s, d, "terms_train").filter("term is not null")
    a = L.generate(F.concat(F.lit("Term?\n"), "term"), partial(L.WordGenerator, 3))
    return t.select("row_pos", a.alias("a")).select("row_pos", F.array_join("a.types", ",").alias("types"), "a.attempts", "a.ok")


_SAID = "list_sort(list_distinct(list_filter(string_split(term, ' '), lambda x: length(x) > 3)))"


@query("predict_types", f"""WITH t AS (SELECT row_pos, list_sort(list_distinct(coalesce(types, []))) AS t, {_SAID} AS g FROM terms_train WHERE term IS NOT NULL AND len(types) > 0),
m AS (SELECT len(list_intersect(t, g)) AS b, len(list_distinct(list_concat(t, g))) AS o, len(t) + len(g) AS a FROM t)
SELECT round(avg(b / o), 6) AS jaccard, round(avg(2 * b / a), 6) AS f1, round(avg(CAST(b = o AS DOUBLE)), 6) AS exact, count(*) AS n FROM m""")
def _(s, d):
    t = table(s, d, "terms_train").filter("term is not null and size(types) > 0").select(F.col("row_pos").cast("string").alias("id"), "term", "types")
    p = t.select("id", L.generate(F.concat(F.lit("Term?\n"), "term"), L.WordGenerator).alias("a")).select("id", "a.types")
    return L.typing_metrics(t, p).select(*[_r(c).alias(c) for c in ("jaccard", "f1", "exact")], "n")


_FROM_SCORES = _PAIRS.rstrip() + ", x AS (SELECT i AS child_id, j AS parent_id, score AS confidence FROM sc WHERE score > 0.25 AND score >= 0.3 ORDER BY score DESC, i, j LIMIT 200)\n"


def _extracted(s, d) -> DataFrame:
    return L.extract_relationships(S.pairs(_emb(s, d), "vec_id", "embedding", above=0.25), 0.25, 0.3, 200)


@query("extract_relationships", _FROM_SCORES + "SELECT child_id, parent_id, round(confidence, 6) AS confidence FROM x")
def _(s, d):
    return _extracted(s, d).withColumn("confidence", _r("confidence"))


@query("confidence_stats", _FROM_SCORES + "SELECT count(*) AS n, count(DISTINCT parent_id) AS parents, count(DISTINCT child_id) AS children, round(min(confidence), 6) AS low, round(max(confidence), 6) AS high, round(avg(confidence), 6) AS mean, round(stddev_pop(confidence), 6) AS std FROM x")
def _(s, d):
    return L.confidence_stats(_extracted(s, d)).select("n", "parents", "children", *[_r(c).alias(c) for c in ("low", "high", "mean", "std")])


@query("threshold_rerun", _PAIRS + "SELECT 0.3::DOUBLE AS old_threshold, 0.35::DOUBLE AS new_threshold, count(*) AS total, count(*) FILTER (score > 0.3) AS old_pairs, count(*) FILTER (score > 0.35) AS new_pairs, count(*) FILTER (score > 0.35) - count(*) FILTER (score > 0.3) AS difference FROM sc WHERE score > 0.25")
def _(s, d):
    return L.threshold_rerun(S.pairs(_emb(s, d), "vec_id", "embedding", above=0.25), 0.3, 0.35).drop("low", "high", "mean", "std")


@query("threshold_changes", _PAIRS + "SELECT i, j, round(score, 6) AS score, 'lost' AS change FROM sc WHERE score > 0.3 AND NOT score > 0.32")
def _(s, d):
    return L.changed_pairs(S.pairs(_emb(s, d), "vec_id", "embedding", above=0.25), 0.3, 0.32).withColumn("score", _r("score"))


@query("relation_ratios", _PAIRS + "SELECT round(100 * count(*) / n ** 2, 9) AS square_ratio, round(100 * r / e ** 2, 9) AS expected_square_ratio, round(count(*) / n, 9) AS ratio, round(r / e, 9) AS expected_ratio FROM sc, (SELECT count(*) AS n FROM embeddings), (SELECT count(*) AS e FROM entities), (SELECT count(*) AS r FROM (SELECT DISTINCT parent_id, child_id FROM relation_pairs WHERE parent_id IS NOT NULL AND child_id IS NOT NULL)) WHERE score > 0.3 GROUP BY n, e, r")
def _(s, d):
    found = S.PairScores(_emb(s, d), "vec_id", "embedding").passed([0.3]).filter("b = 1").agg(F.coalesce(F.sum(F.col("pos") + F.col("neg")), F.lit(0))).first()[0]
    ratios = L.relation_ratios(found, _emb(s, d).count(), _pairs(s, d).count(), table(s, d, "entities").count())
    return s.createDataFrame([tuple(ratios.values())], ", ".join(f"{k} double" for k in ratios)).select(*[F.round(c, 9).alias(c) for c in ratios])


@query("predict_hierarchy", f"""WITH t AS (SELECT row_number() OVER (ORDER BY encode(term)) - 1 AS id, term AS text, {_LETTERS.format("lower(term)")} AS v FROM top_terms),
u AS (SELECT id, text, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS u FROM t),
n AS (SELECT id, text, list_transform(u, lambda x: x / sqrt(list_dot_product(u, u) / 26 + 1e-6)) AS x FROM u),
h AS (SELECT id, text, g, x[g * 13 + 1:g * 13 + 13] AS x FROM n, range(2) r(g)),
e AS (SELECT a.id AS i, b.id AS j, a.text AS child, b.text AS parent, a.g, exp(list_dot_product(a.x, b.x) * 13 ** -0.5) AS e FROM h a JOIN h b ON a.g = b.g),
p AS (SELECT *, e / sum(e) OVER (PARTITION BY i, g) AS p FROM e)
SELECT i::BIGINT AS child_id, j::BIGINT AS parent_id, round(avg(p), 6) AS confidence, child, parent FROM p WHERE i <> j GROUP BY i, j, child, parent HAVING avg(p) > 0.09""")
def _(s, d):
    t = numbered(table(s, d, "top_terms").select(F.col("term").alias("text")), "text", "id")
    return L.predict_hierarchy(t, L.LetterEncoder, threshold=0.09).withColumn("confidence", _r("confidence"))


# prompts and training texts

_REPR = "concat('[', array_to_string(list_transform(types, lambda t: concat('''', t, '''')), ', '), ']')"
_BLOCK = f"""WITH e AS (SELECT term, types, row_number() OVER (ORDER BY row_pos) AS r FROM terms_train WHERE term IS NOT NULL AND len(types) > 0 AND NOT contains(array_to_string(types, ''), '''') ORDER BY row_pos LIMIT 3),
x AS (SELECT concat(chr(10), chr(10), 'CLASSIFICATION EXAMPLES:', chr(10), string_agg(concat(r, '. Term: ''', term, ''' → Types: ', {_REPR}, chr(10)), '' ORDER BY r), chr(10), 'END OF EXAMPLES.', chr(10)) AS x FROM e),
"""
_ASKED = "concat(x, chr(10), 'TERM: ', term, chr(10), chr(10), 'TASK: " + P.TASK + "')"
_TURN = "concat('<|im_start|>{0}', chr(10), {1}, '<|im_end|>', chr(10))"
_SYSTEM = "'" + P.SYSTEM.replace("'", "''") + "'"


def _shots(s, d):
    t = table(s, d, "terms_train").filter("term is not null and size(types) > 0 and not contains(array_join(types, ''), \"'\")")
    few = t.orderBy("row_pos").limit(3)
    return few.agg(F.transform(F.array_sort(F.collect_list(F.struct("row_pos", "term", "types"))), lambda e: F.struct(e["term"].alias("term"), e["types"].alias("types"))).alias("shots"))


@query("prompt_inference", _BLOCK + f"""a AS (SELECT row_pos, concat({_TURN.format('system', _SYSTEM)}, {_TURN.format('user', _ASKED)}, '<|im_start|>assistant', chr(10)) AS t FROM terms_train, x WHERE term IS NOT NULL)
SELECT row_pos, md5(t) AS chat, length(t) AS size FROM a""")
def _(s, d):
    t = table(s, d, "terms_train").filter("term is not null").join(F.broadcast(_shots(s, d)))
    chat = P.chat_template(P.conversation(P.few_shot(F.col("shots"), F.col("term"), 3)), ask=True)
    return t.select("row_pos", F.md5(chat).alias("chat"), F.length(chat).cast("long").alias("size"))


@query("training_texts", _BLOCK + f"""a AS (SELECT row_pos, concat({_TURN.format('system', _SYSTEM)}, {_TURN.format('user', _ASKED)},
  {_TURN.format('assistant', "concat('{\"reasoning\": \"', term, ' is known\", \"types\": [', array_to_string(list_transform(types, lambda t: concat('\"', t, '\"')), ', '), ']}')")}) AS t FROM terms_train, x
  WHERE term IS NOT NULL AND types IS NOT NULL AND NOT contains(concat(term, array_to_string(types, '')), '"') AND NOT contains(term, chr(92)))
SELECT row_pos, md5(t) AS text FROM a""")
def _(s, d):
    t = table(s, d, "terms_train").filter("term is not null and types is not null and not contains(concat(term, array_join(types, '')), '\"') and not contains(term, char(92))").join(F.broadcast(_shots(s, d)))
    text = P.training_text(F.col("term"), F.col("types"), F.concat("term", F.lit(" is known")), P.choose_examples(F.lit(None).cast("array<struct<term:string,types:array<string>>>"), F.col("shots")))
    return t.select("row_pos", F.md5(text).alias("text"))


_NAME = "concat(strftime(o_orderdate, '%Y%m%d_%H%M%S'), '_', replace(o_orderpriority, '_', ''), '_ep', o_orderkey % 90 + 1, '_lr', CASE o_orderkey % 3 WHEN 0 THEN '1e-05' WHEN 1 THEN '5e-04' ELSE '1e-03' END, '_bs', (o_orderkey % 4 + 1) * 16, '_eval', 50, '_seed', o_custkey, CASE o_orderkey % 2 WHEN 0 THEN '_freeze_lora_r8_a16' ELSE '' END)"


@query("run_names", f"SELECT o_orderkey, {_NAME} AS name FROM orders")
def _(s, d):
    return _named_runs(s, d).select("o_orderkey", "name")


def _named_runs(s, d) -> DataFrame:
    o, k = table(s, d, "orders"), F.col("o_orderkey")
    lr = F.when(k % 3 == 0, F.lit(1e-5)).when(k % 3 == 1, F.lit(5e-4)).otherwise(F.lit(1e-3))
    freeze = F.when(k % 2 == 0, F.lit("freeze_lora_r8_a16"))
    name = P.run_name(F.col("o_orderdate"), F.replace("o_orderpriority", F.lit("_"), F.lit("")), k % 90 + 1, lr, (k % 4 + 1) * 16, F.lit(50), F.col("o_custkey"), freeze)
    return o.select("o_orderkey", name.alias("name"))


@query("run_names_parsed", "SELECT o_orderkey, replace(o_orderpriority, '_', '') AS dataset, (o_orderkey % 90 + 1)::INTEGER AS epochs, CASE o_orderkey % 3 WHEN 0 THEN 1e-5::DOUBLE WHEN 1 THEN 5e-4::DOUBLE ELSE 1e-3::DOUBLE END AS lr, ((o_orderkey % 4 + 1) * 16)::INTEGER AS batch, o_custkey::INTEGER AS seed, CASE o_orderkey % 2 WHEN 0 THEN 'lora' END AS freeze, CASE o_orderkey % 2 WHEN 0 THEN 16 END AS alpha, 'single' AS dataset_strategy, date_trunc('second', o_orderdate) AS at FROM orders")
def _(s, d):
    r = _named_runs(s, d).select("o_orderkey", P.parse_run(F.col("name")).alias("r"))
    return r.select("o_orderkey", "r.dataset", "r.epochs", "r.lr", "r.batch", "r.seed", "r.freeze", "r.alpha", "r.dataset_strategy", "r.at")


@query("output_names", """SELECT doc_id, concat('taskB_termtyping_', CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'test' ELSE 'unknown' END, '_results', CASE WHEN doc_id % 2 = 0 THEN '_rag_amount_5' WHEN doc_id % 5 = 0 THEN '' ELSE '_few_shot' END,
  CASE WHEN lang IS NULL THEN '' ELSE concat('_', lang) END, '_big_model', CASE WHEN doc_id % 7 = 0 THEN '_structured' ELSE '' END, CASE WHEN doc_id % 4 = 0 THEN '' ELSE concat('_batch_', doc_id % 4 + 1) END, '.json') AS name FROM documents""")
def _(s, d):
    k = F.col("doc_id")
    path = F.concat(F.lit("data/"), F.when(k % 3 == 0, "Train_set").when(k % 3 == 1, "x/test_data").otherwise("other"), F.lit("/a.json"))
    shots = F.when(k % 2 == 0, F.lit(5)).when(k % 5 == 0, F.lit(None).cast("int")).otherwise(F.lit(0))
    name = P.output_name(path, F.lit("org/big-model"), F.coalesce("lang", F.lit("unknown")), shots, k % 2 == 0, k % 7 == 0, k % 4 + 1, F.lit(42))
    return table(s, d, "documents").select("doc_id", name.alias("name"))


@query("few_shot_source", "SELECT row_pos, CASE WHEN row_pos % 2 = 0 AND len(types) > 0 THEN 'near' ELSE 'fixed' END AS source, concat('_threshold_', replace(format('{:.3f}', (row_pos % 100) / 100), '.', '')) AS suffix FROM terms_train")
def _(s, d):
    t = table(s, d, "terms_train")
    near = F.when(F.col("row_pos") % 2 == 0, F.transform(F.col("types"), lambda t: F.lit("near")))
    return t.select("row_pos", F.get(P.choose_examples(near, F.array(F.lit("fixed"))), F.lit(0)).alias("source"), P.file_suffix((F.col("row_pos") % 100) / 100).alias("suffix"))


# batches and samples

_MEMBERS = "g AS (SELECT DISTINCT CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS grp, id FROM entities)"
_IN_GROUP = f"WITH {_MEMBERS}, p AS (SELECT DISTINCT parent_id, child_id FROM relation_pairs WHERE parent_id IS NOT NULL AND child_id IS NOT NULL)"


@query("balanced_batch", _IN_GROUP + f""", k AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY {_u("'c'", "id")}, id) - 1 AS pos FROM g QUALIFY pos < 32),
l AS (SELECT k.grp, parent_id AS id, count(*) AS w FROM p JOIN k ON k.id = child_id JOIN g ON g.grp = k.grp AND g.id = parent_id GROUP BY ALL),
a AS (SELECT grp, id, 0 AS tier, row_number() OVER (PARTITION BY grp ORDER BY -ln({_u("'p'", "id")}) / w, id) AS r FROM l
  UNION ALL SELECT grp, id, 1, row_number() OVER (PARTITION BY grp ORDER BY {_u("'o'", "id")}, id) FROM g WHERE (grp, id) NOT IN (SELECT (grp, id) FROM l))
SELECT grp, 'child' AS side, pos::INTEGER AS pos, id FROM k UNION ALL SELECT grp, 'parent', (row_number() OVER (PARTITION BY grp ORDER BY tier, r) - 1)::INTEGER AS pos, id FROM a QUALIFY pos < 32""")
def _(s, d):
    return R.balanced_batch(_groups(s, d), _pairs(s, d), 32)


def _grouped_pairs(s, d) -> DataFrame:
    return R.in_one_group(_pairs(s, d), _groups(s, d))


def _draw_sql(source: str, salt: str, n: int) -> str:
    """SQL of ``draw``: rows of ``source (grp, id)``."""
    ranked = f"(SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY {_u(f"'{salt}'", 'id')}, id) - 1 AS r FROM {source} QUALIFY r < {n})"
    size = f"(SELECT grp, least(count(*), {n}) AS size FROM {source} GROUP BY grp)"
    again = f"SELECT z.grp, i AS draw, q.id FROM {size} z CROSS JOIN range({n}) t(i) JOIN {ranked} q ON q.grp = z.grp AND q.r = CAST(floor({_u(f"'{salt}'", 'z.grp', "'#'", 'i')} * size) AS BIGINT) WHERE size < {n}"
    return f"(SELECT q.grp, r AS draw, id FROM {ranked} q JOIN {size} z USING (grp) WHERE size = {n} UNION ALL {again})"


@query("related_batch", f"WITH {_MEMBERS}, p AS (SELECT DISTINCT a.grp, parent_id, child_id FROM relation_pairs JOIN g a ON a.id = parent_id JOIN g b ON b.id = child_id WHERE a.grp = b.grp), kid AS (SELECT DISTINCT grp, child_id AS id FROM p), par AS (SELECT DISTINCT grp, parent_id AS id FROM p), c AS {_draw_sql('kid', 'c', 16)}, "
       f"r AS (SELECT DISTINCT p.grp, parent_id AS id FROM p JOIN c ON c.grp = p.grp AND c.id = child_id), f AS (SELECT grp, id, row_number() OVER (PARTITION BY grp ORDER BY {_u("'r'", 'id')}, id) - 1 AS pos FROM r QUALIFY pos < 8), "
       f"o AS (SELECT * FROM par WHERE (grp, id) NOT IN (SELECT (grp, id) FROM f)), m AS (SELECT * FROM o UNION ALL SELECT * FROM par WHERE grp NOT IN (SELECT grp FROM o)), w AS {_draw_sql('m', 'o', 16)}, n AS (SELECT grp, count(*) AS n FROM f GROUP BY grp) "
       "SELECT grp, 'child' AS side, draw::INTEGER AS pos, id FROM c UNION ALL SELECT grp, 'parent', pos::INTEGER, id FROM f UNION ALL SELECT w.grp, 'parent', (draw + n)::INTEGER, id FROM w JOIN n USING (grp) WHERE draw < 16 - n")
def _(s, d):
    return R.related_batch(_grouped_pairs(s, d), 16)


@query("dataset_choices", f"""WITH g AS (SELECT DISTINCT CASE WHEN trim(coalesce(dataset, '')) = '' THEN 'default' ELSE lower(trim(dataset)) END AS grp FROM entities), r AS (SELECT grp, row_number() OVER (ORDER BY grp) - 1 AS place, count(*) OVER () AS n FROM g)
SELECT i AS draw, 'sequential' AS how, grp FROM range(50) t(i) JOIN r ON i % n = place UNION ALL SELECT i, 'random', grp FROM range(50) t(i) JOIN r ON CAST(floor({_U.format('i')} * n) AS BIGINT) = place UNION ALL SELECT i, 'single', grp FROM range(50) t(i) JOIN r ON place = 0""")
def _(s, d):
    w = _groups(s, d).select("grp", F.lit(1.0).alias("weight")).distinct()
    draws = s.range(50).select(F.col("id").alias("draw"))
    parts = [R.choose_group(w, draws, how).select("draw", F.lit(how).alias("how"), "grp") for how in ("sequential", "random", "single")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("off_diagonal_sample", f"""WITH n AS (SELECT count(*) AS n FROM embeddings), v AS (SELECT embedding, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
d AS (SELECT k AS draw, CAST(floor({_u("'i'", "k")} * n) AS BIGINT) AS i, CAST(floor({_u("'j'", "k")} * (n - 1)) AS BIGINT) AS j FROM range(2000) t(k), n)
SELECT draw, i, j + CAST(j >= i AS BIGINT) AS j, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM d JOIN v a ON a.pos = i JOIN v b ON b.pos = j + CAST(j >= i AS BIGINT)""")
def _(s, d):
    from ontospark.functions.vector import dot
    v = numbered(_emb(s, d).select("vec_id", "embedding"), "vec_id")
    drawn = R.off_diagonal_sample(v.count(), s.range(2000).select(F.col("id").alias("draw")))
    a, b = v.select(F.col("pos").alias("i"), F.col("embedding").alias("a")), v.select(F.col("pos").alias("j"), F.col("embedding").alias("b"))
    return drawn.join(a, "i").join(b, "j").select("draw", "i", "j", _r(dot(F.col("a"), F.col("b"))).alias("score"))


_PHRASES = f"""WITH t AS (SELECT term, row_number() OVER (ORDER BY encode(term)) - 1 AS pos, count(*) OVER () AS n FROM (SELECT DISTINCT {_K.format('term')} AS term FROM terms_train WHERE {_K.format('term')} <> '')),
e AS (SELECT i AS example, 5 + CAST(floor({_u("'n'", "i")} * 16) AS INTEGER) AS size, k FROM range(40) a(i), range(40) b(k)),
f AS (SELECT example, size, CAST(floor({_u("example", "'#'", "k")} * (SELECT max(n) FROM t)) AS BIGINT) AS pos, min(k) AS k FROM e GROUP BY ALL),
s AS (SELECT example, (row_number() OVER (PARTITION BY example ORDER BY k) - 1)::INTEGER AS at_, size, pos FROM f QUALIFY at_ < size)
"""


def _phrase_sets(s, d) -> DataFrame:
    t = table(s, d, "terms_train").select(term_key(F.col("term")).alias("term")).filter("term <> ''")
    return R.phrase_sets(t, s.range(40).select(F.col("id").alias("example")))


@query("phrase_sets", _PHRASES + "SELECT example, at_ AS at, term FROM s JOIN t USING (pos)".replace("AS at,", "AS place,"))
def _(s, d):
    return _phrase_sets(s, d).withColumnRenamed("at", "place")


@query("phrase_labels", _PHRASES + f", l AS (SELECT DISTINCT {_K.format('child')} AS child, {_K.format('parent')} AS parent FROM relations), w AS (SELECT example, term FROM s JOIN t USING (pos)) SELECT a.example, count(*) AS cells, count(l.child) AS related FROM w a JOIN w b USING (example) LEFT JOIN l ON l.child = a.term AND l.parent = b.term GROUP BY a.example")
def _(s, d):
    links = table(s, d, "relations").select(term_key(F.col("child")).alias("child"), term_key(F.col("parent")).alias("parent"))
    return R.phrase_labels(_phrase_sets(s, d), links).groupBy("example").agg(F.count("*").alias("cells"), F.sum("y").cast("long").alias("related"))


@query("batches", "SELECT id, CAST((row_number() OVER (ORDER BY id) - 1) // 32 AS BIGINT) AS batch, CAST((row_number() OVER (ORDER BY id) - 1) % 32 AS BIGINT) AS slot, greatest(1, (SELECT count(*) FROM entities) // 64) AS epoch FROM entities")
def _(s, d):
    e = table(s, d, "entities").select("id")
    return R.batches(e, "id", 32).withColumn("epoch", F.lit(R.batch_count(e.count(), 32, 64)).cast("long"))


@query("zip_by_position", "SELECT s_suppkey, c_custkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS r FROM supplier) JOIN (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r FROM customer) USING (r)")
def _(s, d):
    return R.zipped(table(s, d, "supplier").select("s_suppkey"), table(s, d, "customer").select("c_custkey"), "s_suppkey", "c_custkey")


@query("full_matrix", _PAIRS + "SELECT i, j, round(score, 6) AS score, CASE WHEN (i, j) IN (SELECT (parent_id, child_id) FROM relation_pairs WHERE parent_id IS NOT NULL) THEN 1 ELSE 0 END AS y FROM sc WHERE score > 0.3")
def _(s, d):
    links = table(s, d, "relation_pairs").select(F.col("parent_id").alias("i"), F.col("child_id").alias("j"))
    return R.full_matrix(S.pairs(_emb(s, d), "vec_id", "embedding", above=0.3), links).withColumn("score", _r("score"))


@query("pair_texts", "SELECT pair_id, coalesce(p.text_description, '') AS parent, coalesce(c.text_description, '') AS child FROM relation_pairs LEFT JOIN entities p ON p.id = parent_id LEFT JOIN entities c ON c.id = child_id")
def _(s, d):
    names = table(s, d, "entities").select("id", F.col("text_description").alias("text"))
    return R.with_text(table(s, d, "relation_pairs").select("pair_id", "parent_id", "child_id"), names).select("pair_id", "parent", "child")


@query("term_ids", f"SELECT row_pos, coalesce(e.id, -1) AS id FROM terms_train LEFT JOIN (SELECT {_K.format('text_description')} AS t, max(id) AS id FROM entities WHERE {_K.format('text_description')} <> '' GROUP BY 1) e ON e.t = {_K.format('term')}")
def _(s, d):
    names = R.last_by_text(table(s, d, "entities").select("id", term_key(F.col("text_description")).alias("t")), "t", "id")
    return R.with_id(table(s, d, "terms_train").select("row_pos", term_key(F.col("term")).alias("term")), names).select("row_pos", "id")


@query("unknown_terms", f"WITH e AS (SELECT {_K.format('text_description')} AS t FROM entities WHERE text_description IS NOT NULL), r AS (SELECT rel_id, {_K.format('parent')} AS p, {_K.format('child')} AS c FROM relations WHERE parent IS NOT NULL AND child IS NOT NULL) SELECT 'known' AS what, count(*) AS n FROM r WHERE p IN (SELECT t FROM e) AND c IN (SELECT t FROM e) UNION ALL SELECT 'unknown', count(*) FROM r WHERE NOT (p IN (SELECT t FROM e) AND c IN (SELECT t FROM e))")
def _(s, d):
    t = table(s, d, "entities").select(term_key(F.col("text_description")).alias("term")).filter("term is not null")
    r = table(s, d, "relations").select("rel_id", term_key(F.col("parent")).alias("parent"), term_key(F.col("child")).alias("child")).filter("parent is not null and child is not null")
    count = lambda absent, what: R.known_terms(r, t, absent).agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return count(False, "known").unionByName(count(True, "unknown"))


@query("dataset_info", _IN_GROUP + ", r AS (SELECT a.grp, parent_id, child_id FROM relation_pairs JOIN g a ON a.id = parent_id JOIN g b ON b.id = child_id AND a.grp = b.grp), c AS (SELECT grp, count(*) AS relations, count(DISTINCT (parent_id, child_id)) AS distinct_relations FROM r GROUP BY grp) SELECT grp, count(*) AS entities, coalesce(max(relations), 0)::BIGINT AS relations, coalesce(max(distinct_relations), 0)::BIGINT AS distinct_relations FROM g LEFT JOIN c USING (grp) GROUP BY grp")
def _(s, d):
    return R.dataset_info(_groups(s, d), table(s, d, "relation_pairs"))


@query("validation_report", """WITH e AS (SELECT count(*) AS entities, count(*) FILTER (len(embedding) > 0 AND trim(coalesce(text_description, '')) <> '') AS valid_entities, count(DISTINCT len(embedding)) FILTER (len(embedding) > 0) AS dims FROM entities),
r AS (SELECT count(*) AS relations, count(*) FILTER (a.id IS NOT NULL AND b.id IS NOT NULL) AS valid_relations, count(*) FILTER (parent_id IS NOT NULL AND a.id IS NULL) AS unknown_parent FROM relation_pairs LEFT JOIN entities a ON a.id = parent_id LEFT JOIN entities b ON b.id = child_id)
SELECT entities, valid_entities, dims, relations, valid_relations, unknown_parent, entities = valid_entities AND relations = valid_relations AND dims = 1 AS ok FROM e, r""")
def _(s, d):
    return R.validation_report(table(s, d, "entities"), table(s, d, "relation_pairs")).select("entities", "valid_entities", "dims", "relations", "valid_relations", "unknown_parent", "ok")


# runs and logs


@query("mean_epoch_loss", "SELECT event_id // 1000 AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1")
def _(s, d):
    e = table(s, d, "events").withColumn("e", F.floor(F.col("event_id") / 1000))
    return X.mean_loss(e, "e", "value").withColumn("loss", _r("loss"))


@query("timing_stats", "SELECT size, count(*) AS trials, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, size * size AS comparisons, round(avg(value) / (size * size) * 1000, 6) AS ms_each FROM (SELECT (event_id % 5 + 1) * 10 AS size, value FROM events) GROUP BY size")
def _(s, d):
    t = X.timing(table(s, d, "events").select(((F.col("event_id") % 5 + 1) * 10).alias("n"), "value"), "n", "value")
    return t.select("size", "trials", _r("mean").alias("mean"), _r("std").alias("std"), "comparisons", _r("ms_each").alias("ms_each"))


@query("job_outcomes", "SELECT event_type, count(*) FILTER (value > 50) AS done, count(*) FILTER (NOT value > 50) AS failed, round(avg(CAST(value > 50 AS DOUBLE)), 6) AS share FROM events GROUP BY event_type")
def _(s, d):
    return X.outcomes(table(s, d, "events").withColumn("ok", F.col("value") > 50), "event_type", "ok").withColumn("share", _r("share"))


@query("best_runs", "SELECT p_brand, p_partkey, p_name, p_retailprice FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) = 1")
def _(s, d):
    return X.best_run(table(s, d, "part").select("p_brand", "p_partkey", "p_name", "p_retailprice"), "p_brand", "p_retailprice", "p_partkey")


@query("models_compared", "SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 10")
def _(s, d):
    return X.compared(table(s, d, "supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", "s_suppkey").limit(10)


@query("merged_summaries", "SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(c_name, s_name) AS name, coalesce(c_acctbal, s_acctbal) AS score, s_nationkey AS nation FROM customer FULL JOIN supplier ON c_custkey = s_suppkey")
def _(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("score"))
    p = table(s, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"), F.col("s_nationkey").alias("nation"))
    return X.merged_summaries(c, p, "key")


@query("moving_average_own_width", "WITH e AS (SELECT event_type, event_id AS step, greatest(5, count(*) OVER (PARTITION BY event_type) // 20) AS w, count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, sum(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS s FROM events) SELECT a.event_type, a.step, round((a.s - coalesce(b.s, 0)) / a.w, 4) AS average FROM e a LEFT JOIN e b ON b.event_type = a.event_type AND b.r = a.r - a.w WHERE a.r >= a.w AND a.n > 10")
def _(s, d):
    log = table(s, d, "events").select("event_type", F.col("event_id").alias("step"), "value")
    return X.moving_average(log, "event_type", "step", "value").withColumn("average", F.round("average", 4))


# graphs, weights, labels


@query("hierarchy_depth", _TREE.replace("WITH r", "WITH RECURSIVE r") + ", w AS (SELECT child, 1 AS d FROM l WHERE parent NOT IN (SELECT child FROM l) UNION ALL SELECT l.child, d + 1 FROM w JOIN l ON l.parent = w.child) SELECT max(d)::BIGINT AS max_depth FROM w")
def _(s, d):
    return G.max_depth(term_links(table(s, d, "relations")))


@query("degree_counts", _TREE + "SELECT coalesce(a.parent, b.child) AS term, coalesce(n, 0) AS children, coalesce(m, 0) AS parents FROM (SELECT parent, count(*) AS n FROM l GROUP BY parent) a FULL JOIN (SELECT child, count(*) AS m FROM l GROUP BY child) b ON a.parent = b.child")
def _(s, d):
    return G.degree_counts(term_links(table(s, d, "relations")))


@query("structure_report", _TREE.replace("WITH r", "WITH RECURSIVE r") + """, n AS (SELECT child AS node FROM l UNION SELECT parent FROM l UNION SELECT DISTINCT lower(trim(term)) FROM top_terms),
q AS (SELECT node, node IN (SELECT child FROM l) AS c, node IN (SELECT parent FROM l) AS p FROM n),
w AS (SELECT child, 1 AS d FROM l WHERE parent NOT IN (SELECT child FROM l) UNION ALL SELECT l.child, d + 1 FROM w JOIN l ON l.parent = w.child)
SELECT count(*) AS terms, count(*) FILTER (p AND NOT c) AS root, count(*) FILTER (c AND NOT p) AS leaf, count(*) FILTER (c AND p) AS intermediate, count(*) FILTER (NOT c AND NOT p) AS isolated, (SELECT count(*) FROM l) AS links, (SELECT max(d) FROM w)::BIGINT AS max_depth, round((SELECT count(*) FROM l) / (count(*) * (count(*) - 1.0)), 12) AS density FROM q""")
def _(s, d):
    links = term_links(table(s, d, "relations"))
    nodes = links.select(F.explode(F.array("child", "parent")).alias("node")).union(table(s, d, "top_terms").select(term_key(F.col("term")))).distinct()
    return G.structure_report(links, nodes).select("terms", "root", "leaf", "intermediate", "isolated", "links", "max_depth", F.round("density", 12).alias("density"))


_LIMIT = _GRAPH.replace("WITH sc", "WITH RECURSIVE sc") + """, o AS (SELECT src, sum(weight) AS total FROM b GROUP BY src), f AS (SELECT b.src, b.dst, weight / total AS share FROM b JOIN o USING (src)), n AS (SELECT count(DISTINCT src) AS n FROM b),
pr AS (SELECT 0 AS k, src AS node, 1.0::DOUBLE / n AS rank FROM (SELECT DISTINCT src FROM b), n UNION ALL SELECT k + 1, dst, 0.15 / max(n) + 0.85 * sum(share * rank) FROM pr JOIN f ON node = src, n WHERE k < 100 GROUP BY k, dst),
dg AS (SELECT src AS node, count(*) AS d FROM b GROUP BY src), t3 AS (SELECT x.src AS node, count(*) AS t FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN g ON g.src = x.dst AND g.dst = y.dst GROUP BY x.src)
"""


@query("graph_feature_matrix", _LIMIT + "SELECT dg.node AS vec_id, d::DOUBLE AS degree, round(CASE WHEN d < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (d * (d - 1)) END, 6)::DOUBLE AS clustering, round(d / (n - 1), 6) AS centrality, round(rank, 6) AS pagerank, 68::BIGINT AS width FROM dg LEFT JOIN t3 USING (node) JOIN pr ON pr.node = dg.node AND k = 100, n")
def _(s, d):
    e = _emb(s, d)
    f = C.graph_features(_near_graph(s, d), e.select(F.col("vec_id").alias("node")), tol=1e-9)
    x = C.with_graph(e, f, "vec_id", "embedding")
    at = lambda k: F.element_at("embedding", k)
    return x.select("vec_id", at(65).alias("degree"), _r(at(66)).alias("clustering"), _r(at(67)).alias("centrality"), _r(at(68)).alias("pagerank"), F.size("embedding").cast("long").alias("width"))


# the iterate at which the rule stops: the first whose ranks moved by less than 1e-6 a node in sum
SQL["pagerank_converged"] = _LIMIT + """SELECT node, round(rank, 8) AS rank FROM pr WHERE k = (
  SELECT min(k) FROM (SELECT a.k, sum(abs(a.rank - b.rank)) AS moved FROM pr a JOIN pr b ON a.node = b.node AND b.k = a.k - 1 GROUP BY a.k), n WHERE moved < n * 1e-6)"""


@query("label_indicators", "WITH v AS (SELECT list(x ORDER BY encode(x)) AS v FROM (SELECT DISTINCT unnest(types) AS x FROM terms_train) WHERE x IS NOT NULL) SELECT row_pos, array_to_string(list_transform(v, lambda x: CASE WHEN list_contains(coalesce(types, []), x) THEN 1 ELSE 0 END), '') AS y FROM terms_train, v")
def _(s, d):
    return C.indicators(table(s, d, "terms_train"), "row_pos", "types").select("row_pos", F.array_join(F.col("y").cast("array<string>"), "").alias("y"))


def _classified(s, d, kind: str) -> DataFrame:
    """Held-out precision, recall and F1: rows with vec_id divisible by 5 are the test rows."""
    e = _emb(s, d).select("vec_id", F.col("embedding").alias("x"), F.array(F.col("label").cast("string")).alias("labels"))
    model = C.OneVsRest(kind, trees=20, depth=5).fit(e.filter("vec_id % 5 <> 0"))
    p = M.pick_labels(model.probabilities(e.filter("vec_id % 5 = 0"), "vec_id"), "vec_id", "label", "p", 0.3)
    return p.withColumnRenamed("labels", "guess").join(e.select("vec_id", F.col("labels").alias("truth")), "vec_id")


@query("classify_forest")
def _(s, d):
    return M.label_metrics(_classified(s, d, "forest"), "truth", "guess")


@query("classify_logistic")
def _(s, d):
    return M.label_metrics(_classified(s, d, "logistic"), "truth", "guess")


def _matrices(s, d):
    """A base matrix of 25 x 64 and its two low-rank parts, read from tables."""
    n = table(s, d, "nation").select(F.lit("q").alias("name"), F.col("n_nationkey").cast("int").alias("row"), F.col("n_regionkey").alias("r"))
    base = n.select("name", "row", F.transform(F.sequence(F.lit(0), F.lit(63)), lambda c: (F.col("row") * 64 + c).cast("double") / 100).alias("values"))
    up = n.select("name", "row", F.array((F.col("r") + 1).cast("double"), (F.col("row") - 3).cast("double")).alias("values"))
    down = _emb(s, d).filter("vec_id in (0, 1)").select(F.lit("q").alias("name"), F.col("vec_id").cast("int").alias("row"), F.col("embedding").alias("values"))
    return base, down, up


@query("lora_merge", "SELECT n_nationkey::INTEGER AS row, c AS col, round((n_nationkey * 64 + c) / 100 + 8.0 * ((n_regionkey + 1) * CAST(a.embedding[c + 1] AS DOUBLE) + (n_nationkey - 3) * CAST(b.embedding[c + 1] AS DOUBLE)), 6) AS value FROM nation, range(64) t(c), (SELECT embedding FROM embeddings WHERE vec_id = 0) a, (SELECT embedding FROM embeddings WHERE vec_id = 1) b")
def _(s, d):
    base, down, up = _matrices(s, d)
    return W.lora_merge(base, down, up, 16, 2).select("row", F.posexplode("values").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), _r("value").alias("value"))


@query("linear_projection", "WITH w AS (SELECT n_nationkey AS r, list_transform(range(64), lambda c: (n_nationkey * 64 + c) / 100) AS v FROM nation) SELECT vec_id, round(sum(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(v AS DOUBLE[]))), 4) AS total, count(*) AS width FROM embeddings, w GROUP BY vec_id")
def _(s, d):
    p = W.projected(_emb(s, d).select("vec_id", "embedding"), _matrices(s, d)[0], "vec_id", "embedding", "q")
    return p.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.size("embedding").cast("long").alias("width"))


@query("parameter_count", "SELECT 25 * 64 + 2 * 64 + 25 * 2 AS parameters, 2 * 64 + 25 * 2 AS trainable, 4 * (25 * 64 + 2 * 64 + 25 * 2) AS bytes")
def _(s, d):
    base, down, up = (m.withColumn("name", F.lit(n)) for m, n in zip(_matrices(s, d), ("base", "down", "up")))
    rows = [m.select("name", F.col("values").cast("array<double>").alias("values")) for m in (base, down, up)]
    return W.parameter_count(rows[0].unionByName(rows[1]).unionByName(rows[2]), s.createDataFrame([("down",), ("up",)], "name string")).select(*[F.col(c).cast("int").alias(c) for c in ("parameters", "trainable", "bytes")])


# exports


def _country(s, d) -> DataFrame:
    n = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))


def _places(s, d) -> DataFrame:
    return _country(s, d).select(F.explode(F.array("child", "parent")).alias("node")).distinct()


_PLACE = "WITH e AS (SELECT n_name AS c, r_name AS p FROM nation JOIN region ON n_regionkey = r_regionkey), n AS (SELECT c AS node FROM e UNION SELECT p FROM e)\n"


@query("export_dot", _PLACE + "SELECT 0 AS part, 'digraph {' AS line UNION ALL SELECT 1, concat('\"', node, '\";') FROM n UNION ALL SELECT 2, concat('\"', c, '\" -> \"', p, '\";') FROM e UNION ALL SELECT 3, '}'")
def _(s, d):
    return files.document_lines(_country(s, d), _places(s, d), "dot")


@query("export_graphml", _PLACE + "SELECT 0 AS part, '<?xml version=\"1.0\" encoding=\"utf-8\"?><graphml xmlns=\"http://graphml.graphdrawing.org/xmlns\"><graph edgedefault=\"directed\">' AS line UNION ALL SELECT 1, concat('<node id=\"', node, '\"/>') FROM n UNION ALL SELECT 2, concat('<edge source=\"', c, '\" target=\"', p, '\"/>') FROM e UNION ALL SELECT 3, '</graph></graphml>'")
def _(s, d):
    return files.document_lines(_country(s, d), _places(s, d), "graphml")


@query("adjacency_matrix", _PLACE + "SELECT a.node, string_agg(CASE WHEN (a.node, b.node) IN (SELECT (c, p) FROM e) THEN '1' ELSE '0' END, ',' ORDER BY encode(b.node)) AS line FROM n a, n b GROUP BY a.node")
def _(s, d):
    return files.adjacency_lines(_country(s, d), _places(s, d))


@query("wide_matrix", "SELECT event_type, " + ", ".join(f"round(sum(value) FILTER (event_id % 3 = {k}), 4) AS c{k}" for k in range(3)) + " FROM events GROUP BY event_type")
def _(s, d):
    e = table(s, d, "events").groupBy("event_type", F.concat(F.lit("c"), (F.col("event_id") % 3).cast("string")).alias("c")).agg(F.round(F.sum("value"), 4).alias("v"))
    return files.wide(e, "event_type", "c", "v")


@query("metrics_report", "SELECT concat('Method comparison for domain x', chr(10), chr(10), string_agg(m, concat(chr(10), chr(10)) ORDER BY event_type)) AS line FROM (SELECT event_type, concat(upper(event_type), ':', chr(10), 'high: ', format('{:.3f}', max(value)), chr(10), 'low: ', format('{:.3f}', min(value))) AS m FROM events GROUP BY event_type)")
def _(s, d):
    e = table(s, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.max("value").alias("high"), F.min("value").alias("low"))
    return files.metrics_report(e.unpivot("method", ["high", "low"], "metric", "value"), "x")


@query("result_metadata", _PAIRS + "SELECT count(DISTINCT i) AS n_terms, (SELECT count(*) FROM sc WHERE score > 0.4) AS n_pairs, 0.4::DOUBLE AS threshold_used, round(avg(score), 6) AS mean, '{\"dataset\":\"x\"}' AS model_info FROM sc WHERE score > 0.3")
def _(s, d):
    scores = S.pairs(_emb(s, d), "vec_id", "embedding", above=0.3)
    m = files.result_metadata(scores, scores.filter("score > 0.4"), 0.4, dataset="x")
    return m.select("n_terms", "n_pairs", "threshold_used", _r("matrix_stats.mean").alias("mean"), "model_info")


def queries() -> dict:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
