"""Parsing, prompts and labels over texts made from parts, orders, events and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtag.functions import prompts as M
from loomtag.functions import text as X
from loomtag.operators import corpus as C
from loomtag.operators import evaluation as E
from loomtag.operators import sequences as S
from loomtag.operators import tagging as T
from loomtag.plans import views as V
from loomtag.plans.registry import query
from loomtag.plans.sequence_queries import seqs


def _completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item"), F.concat(F.lit("Sure: 1. "), "p_brand", F.lit(", "), "p_type", F.lit("\n2. "), "p_name", F.lit("\n3. **"), "p_brand", F.lit("** or so")).alias("completion"), "p_brand", "p_type", "p_name")


@query("parse_numbered", "SELECT p_partkey AS item, 'brand|' || lower(regexp_replace(p_type, '[0-9]', '', 'g')) || '|' || lower(p_name) AS tags FROM part")
def parse_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _completions(spark, sf_dir).select("item", F.array_join(X.numbered_tags(F.col("completion"), 0, 2), "|").alias("tags"))


_WORDS = "lower(p_name), '[A-Za-z]+'"


@query("parse_numbered_marks", f"""SELECT p_partkey AS item, array_to_string(list_concat([regexp_extract({_WORDS}) || ' first', 'second'], list_concat(regexp_extract_all({_WORDS}), ['x-y', 'end'])), '|') AS tags FROM part""")
def parse_numbered_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several tags in a line, apart by digits, brackets, semicolons and other marks; the last line is dropped."""
    word = F.regexp_extract("p_name", "[A-Za-z]+", 0)
    text = F.concat(F.lit("Tags 2.\n0.\n1. "), word, F.lit(" First; Second (12)\n2. "), F.regexp_replace("p_name", " ", "; "), F.lit(" [X-Y]: 3 end\n3. dropped"))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.array_join(X.numbered_tags(text, 0, -1), "|").alias("tags"))


@query("parse_beams", f"""SELECT p_partkey AS item, array_to_string(list_concat(['in put', 'dr. o''neil'], regexp_extract_all({_WORDS}), ['bold one', 'bold'], regexp_extract_all({_WORDS})), '|') AS tags FROM part""")
def parse_beams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The input line and lines 2 and 3 of two beams: several tags in a line, spans between any number of stars, repeats; a third beam and line are left out."""
    listed = F.regexp_replace("p_name", " ", ", ")
    first = F.concat(F.lit("so 1. In put; Dr. O'Neil\n2. "), listed, F.lit("\n3. a *Bold one* or ***bold*** 5\n4. no"))
    second = F.concat(F.lit("1. other\n3. "), listed)
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.array_join(X.beam_tags(F.array(first, second, first), 1, 3, 2, include_input=True), "|").alias("tags"))


@query("label_normalise", """SELECT o_orderkey AS session_id, CASE o_orderkey % 7 WHEN 6 THEN o_orderpriority || ', or ' || o_orderstatus WHEN 0 THEN o_orderpriority || '|' || o_orderstatus WHEN 1 THEN o_orderpriority WHEN 2 THEN o_orderstatus || '|x' WHEN 3 THEN o_orderpriority || '|' || o_orderstatus WHEN 5 THEN '[' || o_orderpriority || '|' || o_orderstatus || ']' ELSE 'Unknown' END AS labels FROM orders""")
def label_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = V.table(spark, sf_dir, "orders"), F.col("o_orderkey") % 7
    text = (
        F.when(k == 0, F.to_json(F.struct(F.array("o_orderpriority", F.concat(F.lit(" "), "o_orderstatus")).alias("predicted_classes"))))
        .when(k == 1, F.to_json(F.struct(F.col("o_orderpriority").alias("predicted_class"))))
        .when(k == 2, F.concat(F.lit('[7, "'), "o_orderstatus", F.lit('", " x", null, "'), "o_orderstatus", F.lit('"]')))
        .when(k == 3, F.concat("o_orderpriority", F.lit("; "), "o_orderstatus"))
        .when(k == 4, F.lit("{}"))
        .when(k == 5, F.concat(F.lit("["), "o_orderpriority", F.lit(" ; "), "o_orderstatus", F.lit("]")))
        .when(k == 6, F.to_json(F.struct(F.concat("o_orderpriority", F.lit(", or "), "o_orderstatus").alias("predicted_class"))))
    )
    return o.select(F.col("o_orderkey").alias("session_id"), F.array_join(X.normalised_labels(text), "|").alias("labels"))


@query("category_names", """SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 3 THEN n_name || '|b & c/d' ELSE n_name || '|' || n_name || ' b' END AS names FROM nation""")
def category_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in a nested object, a list, a flat object, a loose list on one line and a quoted list on one line."""
    n, k, b = V.table(spark, sf_dir, "nation"), F.col("n_nationkey") % 5, F.concat("n_name", F.lit(" b"))
    text = (
        F.when(k == 0, F.concat(F.lit("Here: "), F.to_json(F.struct(F.struct(F.col("n_name").alias("Category 1"), b.alias("Category 2"), F.lit(3).alias("Category 3")).alias("Categories")))))
        .when(k == 1, F.to_json(F.array("n_name", b, F.lit(" "))))
        .when(k == 2, F.concat(F.to_json(F.struct(F.col("n_name").alias("Category 1"), b.alias("Category 2"))), F.lit(" as asked")))
        .when(k == 3, F.concat(F.lit("Category 1: "), "n_name", F.lit(" , Category 2 - b & c/d.")))
        .otherwise(F.concat(F.lit('{Category 1: "'), "n_name", F.lit('", Category 2 : " '), b, F.lit('"')))
    )
    return n.select("n_nationkey", F.array_join(X.category_names(text), "|").alias("names"))


@query("batch_check", """WITH b AS (SELECT o_orderkey // 4 AS batch, list(o_orderpriority ORDER BY o_orderkey) AS l, count(*) AS n FROM orders GROUP BY 1)
SELECT batch, unnest(range(n))::INT AS pos, CASE WHEN batch % 5 = 0 THEN 'Failed_Prediction' ELSE unnest(l) END AS label FROM b""")
def batch_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = V.table(spark, sf_dir, "orders")
    b = o.groupBy(F.floor(F.col("o_orderkey") / 4).alias("batch")).agg(F.count("*").alias("size"), F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))), lambda x: x["o_orderpriority"]).alias("labels"))
    short = F.when(F.col("batch") % 5 == 0, F.slice("labels", F.lit(1), F.size("labels") - 1)).otherwise(F.col("labels"))
    return X.checked_batches(b.withColumn("labels", short))


@query("top_classes", f"""WITH {V.LABELS_SQL}, b AS (SELECT label FROM session_label WHERE session_id % 9 <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 4),
l AS (SELECT session_id, unnest(labels) AS label, unnest(range(len(labels))) AS pos FROM session_labels WHERE session_id % 9 <> 0)
SELECT session_id, string_agg(label, '|' ORDER BY pos) AS labels FROM l WHERE label IN (SELECT label FROM b) GROUP BY session_id""")
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = V.session_labels(spark, sf_dir).withColumn("labels", F.when(F.col("session_id") % 9 == 0, F.array(F.lit(X.FAILED))).otherwise(F.col("labels")))
    return X.top_classes(labels, 4).select("session_id", F.array_join("labels", "|").alias("labels"))


@query("label_counts", f"WITH {V.LABELS_SQL} SELECT label, count(*) AS n FROM session_label GROUP BY label")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.session_labels(spark, sf_dir).select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("session_text", f"""WITH {V.EVENTS_SQL}, b AS (SELECT "user", string_agg('- ' || action || ' item ' || item, chr(10) ORDER BY ts, '- ' || action || ' item ' || item) AS body, list(DISTINCT action) AS a FROM ev GROUP BY "user")
SELECT "user", 'Session ' || "user" || ':' || chr(10) || body || chr(10) || 'Tags: ' || array_to_string(list_sort(a), ', ') AS text FROM b""")
def session_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir)
    tags = e.groupBy("user").agg(F.array_sort(F.collect_set("action")).alias("tags"))
    return X.session_text(e, "user", ("ts",), F.concat(F.lit("- "), "action", F.lit(" item "), F.col("item").cast("string")), tags)


def _domain_sql(line: str) -> str:
    return f"""WITH {V.EVENTS_SQL}, l AS (SELECT "user", ts, {line} AS line FROM ev LEFT JOIN part ON p_partkey = item),
b AS (SELECT "user", string_agg(line, chr(10) ORDER BY ts, line) AS body FROM l GROUP BY "user")
SELECT "user", CASE WHEN body IS NULL THEN 'Empty session' ELSE 'Session ' || "user" || ':' || chr(10) || body END AS text FROM b"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the name of their part, null where there is none."""
    names = V.table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("item"), "p_name")
    return V.events(spark, sf_dir).join(names, "item", "left")


@query("session_text_actions", _domain_sql("'- ' || CASE WHEN item % 5 = 0 THEN 'load' ELSE action END || ' ''' || p_name || ''''"))
def session_text_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions on named products; a missing action is a load, events without a name have no line."""
    e = _named(spark, sf_dir)
    return X.session_text(e, "user", ("ts",), X.action_line(F.when(F.col("item") % 5 != 0, F.col("action")), F.col("p_name")))


@query("session_text_ratings", _domain_sql("'- ' || strftime(ts, '%H:%M:%S') || ': rated ' || (1 + item % 5) || '/5 ''' || coalesce(p_name, 'Unknown') || ''''"))
def session_text_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of films with the time of day."""
    e = _named(spark, sf_dir)
    return X.session_text(e, "user", ("ts",), X.rating_line(F.col("ts"), 1 + F.col("item") % 5, F.coalesce("p_name", F.lit("Unknown"))))


for _domain, (_verb, _least) in X.VISITS.items():

    def _visits(spark: SparkSession, sf_dir: str, verb=_verb, least=_least) -> DataFrame:
        """Ids of 24 characters, some of 4 that are too short for either domain, and titles for two thirds of them."""
        e, width = _named(spark, sf_dir), F.when(F.col("item") % 7 == 0, 4).otherwise(24)
        return X.session_text(e, "user", ("ts",), X.visit_line(verb, F.lpad(F.col("item").cast("string"), width, F.lit("B")), F.when(F.col("item") % 3 != 0, F.col("p_name")), least))

    query(f"session_text_{_domain}", _domain_sql(f"CASE WHEN item % 7 <> 0 THEN '- {_verb} ''' || coalesce(CASE WHEN item % 3 <> 0 THEN p_name END, lpad(item::VARCHAR, 24, 'B')) || '''' END"))(_visits)


@query("prompt_batches", f"""WITH {V.EVENTS_SQL}, t AS (SELECT row_number() OVER (ORDER BY "user") - 1 AS idx, 'user ' || "user" || ': ' || count(*) AS text FROM ev GROUP BY "user")
SELECT idx // 4 AS batch, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS prompt FROM t GROUP BY 1""")
def prompt_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.events(spark, sf_dir).groupBy("user").agg(F.count("*").alias("n"))
    ids = S.dense_ids(e, "user", "idx").join(e, "user")
    return X.prompt_batches(ids.select("idx", F.concat(F.lit("user "), F.col("user").cast("string"), F.lit(": "), F.col("n").cast("string")).alias("text")))


@query("item_text", "SELECT p_partkey AS item, CASE WHEN p_partkey % 10 = 0 THEN 'unknown item.' ELSE p_brand || ' ' || p_type || ' ' || p_name || '.' END AS text FROM part")
def item_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = V.base_tags(spark, sf_dir)
    return t.select("item", X.item_text(F.when(F.col("item") % 10 != 0, F.col("tags"))).alias("text"))


@query("titles", """SELECT p_partkey AS item, CASE p_partkey % 3 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN 'A ' || p_name ELSE p_name || ', An' END AS title FROM part""")
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(k == 0, ", The").when(k == 1, ", A").otherwise(",\tAn"))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), X.article_first(X.clean_title(title)).alias("title"))


TEMPLATE = "I have seen:\n{history}\nI like {preferences}.\nRank these {n}:\n{candidates}"


@query("rank_prompt", f"""WITH {V.SEQS_SQL}, h AS (SELECT "user", seq[greatest(len(seq) - 5, 0) + 1 :] AS h, seq[1:3] AS c FROM seqs)
SELECT "user", 'I have seen:' || chr(10) || array_to_string(list_transform(h, lambda x, i: i || '. item ' || x), chr(10)) || chr(10) || 'I like tea, milk.' || chr(10) || 'Rank these ' || len(c) || ':' || chr(10) || array_to_string(list_transform(c, lambda x, i: i || '. item ' || x), chr(10)) AS prompt FROM h""")
def rank_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = seqs(spark, sf_dir).select("user", F.transform("seq", lambda x: F.concat(F.lit("item "), x.cast("string"))).alias("seq"))
    return s.select("user", X.rank_prompt(F.lit(TEMPLATE), S.last_n(F.col("seq"), 5), F.slice("seq", 1, 3), F.array(F.lit("tea"), F.lit("milk"))).alias("prompt"))


@query("token_prompts", f"""WITH {V.SEQS_SQL} SELECT "user", '<user_' || "user" || '> has purchased ' || array_to_string(list_transform(seq[1:4], lambda x: '<item_' || x || '>'), ' ') || '.' AS prompt, 'buy <item_' || seq[1] || '> or <item_' || seq[2] || '>' AS repaired FROM seqs""")
def token_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    broken = F.concat(F.lit("buy item_"), F.get("seq", F.lit(0)).cast("string"), F.lit(" or <item_"), F.get("seq", F.lit(1)).cast("string"), F.lit(">"))
    return seqs(spark, sf_dir).select("user", X.token_prompt(F.col("user"), F.slice("seq", 1, 4)).alias("prompt"), X.repaired_tokens(broken).alias("repaired"))


@query("rank_parse_index", f"""WITH {V.SEQS_SQL}, l AS (SELECT "user", unnest(seq) AS item, unnest(range(len(seq))) AS pos FROM seqs), f AS (SELECT "user", item, min(pos) AS pos FROM l WHERE item < 20 GROUP BY 1, 2)
SELECT "user", string_agg(item::VARCHAR, ',' ORDER BY pos) AS idx FROM f GROUP BY "user\"""")
def rank_parse_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    answer = F.concat(F.lit("Here:\n"), F.array_join(F.transform("seq", lambda x: F.concat(F.lit(" "), x.cast("string"))), "\n"))
    got = X.ranked_indexes(answer, 20)
    return seqs(spark, sf_dir).select("user", F.array_join(F.transform(got, lambda x: x.cast("string")), ",").alias("idx")).where("idx <> ''")


@query("rank_parse_text")
def rank_parse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that name the first parts of an order, one of them misspelt, against all parts of the order."""
    names = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), F.concat("p_name", F.lit(" no "), F.col("p_partkey").cast("string")).alias("text"))
    order = Window.partitionBy("session_id").orderBy("item")
    c = V.session_items(spark, sf_dir).join(names, "item").withColumn("pos", F.row_number().over(order)).withColumnRenamed("session_id", "qid")
    said = F.concat(F.col("pos").cast("string"), F.lit(". "), F.when(F.col("pos") == 2, F.regexp_replace("text", "e", "a")).otherwise(F.col("text")))
    answers = c.where("pos <= 3").groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", said.alias("s")))), lambda x: x["s"]), "\n").alias("answer"))
    return X.ranked_by_text(answers, c, 10)


_PREF = f"""WITH {V.TAGS_SQL}, t AS (SELECT item, list_concat(list_transform(tags[1:2], lambda x: x || ' Preference'), tags[3:]) AS tags FROM base_tags)"""


def _preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.transform(F.slice("tags", 1, 2), lambda x: F.concat(x, F.lit(" Preference")))
    return V.base_tags(spark, sf_dir).select("item", F.concat(own, F.slice("tags", F.lit(3), F.size("tags"))).alias("tags"))


@query("preference_first", f"""{_PREF} SELECT item, array_to_string(list_concat(list_transform(tags[1:2], lambda x: replace(x, ' Preference', '')), tags[3:3]), '|') AS tags FROM t""")
def preference_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _preferred(spark, sf_dir).select("item", F.array_join(C.preference_first(F.col("tags"), " Preference", 1), "|").alias("tags"))


@query("preference_hist", f"""WITH {V.ITEMS_SQL}, {V.TAGS_SQL}, l AS (SELECT session_id AS key, unnest(tags[1:2]) AS p FROM session_items JOIN base_tags USING (item)), c AS (SELECT key, p, count(*) AS n FROM l GROUP BY 1, 2)
SELECT key, string_agg(p || ' (' || n || ')', ', ' ORDER BY n DESC, p) AS preferences FROM c GROUP BY key""")
def preference_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = V.session_lines(spark, sf_dir).count()
    parts = _preferred(spark, sf_dir).hint("merge")  # they grow, however small their file
    t = T.spread(V.session_items(spark, sf_dir), n, "item").join(parts, "item").select(F.col("session_id").alias("key"), "tags")
    return X.preference_histogram(T.spread(t, n, "key"), " Preference").select("key", F.array_join("preferences", ", ").alias("preferences"))


@query("event_cells", """SELECT event_id, user_id AS session, event_type AS action, json_extract_string(props, '$.k') AS item FROM events""")
def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = V.table(spark, sf_dir, "events")
    cell = F.format_string("[%d, datetime.datetime(2024, 1, 2), '%s', \"%s\"]", "user_id", "event_type", F.get_json_object("props", "$.k"))
    return e.select("event_id", X.event_cell(cell).alias("c")).select("event_id", "c.session", "c.action", "c.item")


@query("movie_cells", """SELECT p_partkey AS item, (p_size / 2.0)::DOUBLE AS rating, p_name AS title FROM part""")
def movie_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = V.table(spark, sf_dir, "part")
    cell = F.format_string("(datetime.datetime(2024, 1, 2), %.1f, '%s')", F.col("p_size") / 2.0, "p_name")
    return p.select(F.col("p_partkey").alias("item"), X.movie_cell(cell).alias("c")).select("item", "c.rating", "c.title")


@query("answer_logs", """SELECT conv_id, turn, CASE WHEN instr(text, 'a') > 0 THEN text ELSE NULL END AS found FROM conversations WHERE text NOT LIKE '%[%' AND text NOT LIKE '%]%'""")
def answer_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bracketed parts found again in log lines."""
    c = V.table(spark, sf_dir, "conversations").where("text NOT LIKE '%[%' AND text NOT LIKE '%]%'")
    log = F.when(F.contains("text", F.lit("a")), F.concat(F.lit("answer: ["), "text", F.lit("] end"))).otherwise(F.lit("none"))
    return c.select("conv_id", "turn", F.regexp_replace(X.json_array(log), r"^\[|\]$", "").alias("found"))


@query("config_values", "SELECT p_partkey AS item, 'log' || p_size AS seq_weights, p_partkey::VARCHAR AS max_seq_len FROM part")
def config_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("name='bm25' seq_weights='log"), F.col("p_size").cast("string"), F.lit("', max_seq_len="), F.col("p_partkey").cast("string"), F.lit(" k1=1.5"))
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), X.config_value(text, "seq_weights").alias("seq_weights"), X.config_value(text, "max_seq_len").alias("max_seq_len"))


@query("fingerprints", """SELECT p_partkey AS item, sha256('{"p_brand":"' || p_brand || '","p_size":' || p_size || '}') AS hash FROM part""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item"), E.fingerprint(F.col("p_brand"), F.col("p_size")).alias("hash"))


@query("language_check", """SELECT regexp_matches(text, '[一-鿿]') AS cjk, count(*) AS n FROM conversations GROUP BY 1""")
def language_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "conversations").groupBy(X.has_cjk(F.col("text")).alias("cjk")).agg(F.count("*").alias("n"))


@query("normalised_names", """SELECT c_custkey, c_name AS name FROM customer""")
def normalised_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.table(spark, sf_dir, "customer").select("c_custkey", X.normalised_name(F.concat(F.lit(" 　"), "c_name", F.lit("　 "))).alias("name"))


@query("selected_tests", f"""WITH {V.SEQS_SQL}, d AS (SELECT "user", row_number() OVER (ORDER BY md5('7|' || "user"), "user") AS order_no FROM seqs QUALIFY order_no <= 20) SELECT d.order_no, "user", seq[len(seq)] AS target FROM d JOIN seqs USING ("user")""")
def selected_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = S.leave_one_out(seqs(spark, sf_dir))
    drawn = s.select("user", S.seeded_order(7, F.col("user")).alias("o")).orderBy("o", "user").limit(20)
    numbered = drawn.withColumn("order_no", F.row_number().over(Window.orderBy("o", "user")))
    return E.selected_in_order(s.select("user", F.col("test").alias("target")), numbered.select("user", "order_no"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _cases(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {_quoted(v)}" for k, v in values.items()) + " END"


_CLUSTER = {k: M.cluster_template(d, 12, 2) for k, d in M.DOMAINS.items()}
_LABEL = {k: M.label_template(d) for k, d in M.DOMAINS.items()}
_NAMES = list(M.DOMAINS)
_BODIES = f"""WITH {V.EVENTS_SQL}, b AS (SELECT "user" AS key, {_NAMES}[1 + "user" % 4] AS domain, 'user ' || "user" || ': ' || count(*) AS body, list_sort(list(DISTINCT action)) AS acts FROM ev GROUP BY "user"),
r AS (SELECT *, CASE WHEN key % 3 = 0 THEN acts[1:2] END AS high, CASE WHEN key % 2 = 0 THEN acts[2:3] END AS low, CASE WHEN key % 5 <> 0 THEN acts[1:1] END AS previous FROM b)"""


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, domain, body, acts) and the labels of an earlier round, where there are any."""
    u = F.col("key")
    b = V.events(spark, sf_dir).groupBy(F.col("user").alias("key")).agg(F.count("*").alias("c"), F.array_sort(F.collect_set("action")).alias("acts"))
    b = b.select("key", F.element_at(F.array(*map(F.lit, _NAMES)), (1 + u % 4).cast("int")).alias("domain"), F.concat(F.lit("user "), u.cast("string"), F.lit(": "), F.col("c").cast("string")).alias("body"), "acts")
    return b.select("*", F.when(u % 3 == 0, F.slice("acts", 1, 2)).alias("high"), F.when(u % 2 == 0, F.slice("acts", 2, 2)).alias("low"), F.when(u % 5 != 0, F.slice("acts", 1, 1)).alias("previous"))


def _json_sql(column: str) -> str:
    return f"""'["' || array_to_string({column}, '","') || '"]'"""


@query("cluster_prompts", f"""{_BODIES}, x AS (SELECT key, {_cases('domain', _CLUSTER)} AS t, body,
  CASE WHEN high IS NOT NULL THEN chr(10) || chr(10) || '4. Labels to keep where the sessions allow it' || chr(10) || {_json_sql('high')} ELSE '' END ||
  CASE WHEN len(low) > 0 THEN chr(10) || chr(10) || CASE WHEN high IS NULL THEN '4' ELSE '5' END || '. Labels that must not be used again' || chr(10) || {_json_sql('low')}
       WHEN len(previous) > 0 THEN chr(10) || chr(10) || CASE WHEN high IS NULL THEN '4' ELSE '5' END || '. Labels of the last round, as a hint' || chr(10) || {_json_sql('previous')} ELSE '' END AS refs FROM r)
SELECT key, replace(replace(t, '{{references}}', refs), '{{body}}', body) AS prompt FROM x""")
def cluster_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.cluster_prompts(_bodies(spark, sf_dir), M.templates(spark, lambda d: M.cluster_template(d, 12, 2)))


@query("label_prompts", f"""{_BODIES} SELECT key, replace(replace(replace({_cases('domain', _LABEL)}, '{{categories}}', array_to_string(acts, ', ')), '{{n}}', '1'), '{{body}}', body) AS prompt FROM b""")
def label_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _bodies(spark, sf_dir).select("key", "domain", "body", F.lit(1).alias("n"), F.col("acts").alias("categories"))
    return M.label_prompts(b, M.templates(spark, M.label_template))


@query("augment_prompts", f"""{_BODIES} SELECT key, replace({_quoted(M.AUGMENT_TEMPLATE)}, '{{body}}', body) AS prompt FROM b""")
def augment_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.augment_prompts(_bodies(spark, sf_dir).select("key", F.col("body").alias("prompt")))


_RANKING, _UNITS = {k: M.ranking_template(r) for k, r in M.RANKINGS.items()}, {k: r.unit for k, r in M.RANKINGS.items()}


@query("ranking_prompts", f"""WITH {V.SEQS_SQL}, {V.TAGS_SQL}, s AS (SELECT "user" AS key, {_NAMES}[1 + "user" % 4] AS domain, seq[greatest(len(seq) - 5, 0) + 1 :] AS h, seq[1:4] AS c FROM seqs),
hl AS (SELECT key, unnest(h) AS item, unnest(range(len(h))) AS pos FROM s), cl AS (SELECT key, unnest(c) AS item, unnest(range(len(c))) AS pos FROM s),
hp AS (SELECT key, tag, count(*) AS n FROM hl JOIN (SELECT item, unnest(tags[3:4]) AS tag FROM base_tags WHERE item % 3 <> 0) t USING (item) GROUP BY key, tag),
hs AS (SELECT key, string_agg('  - ' || tag || ': ' || n || ' ' || {_cases('domain', _UNITS)}, chr(10) ORDER BY n DESC, tag) AS t FROM hp JOIN s USING (key) GROUP BY key),
ht AS (SELECT key, string_agg(pos || '. item ' || item, chr(10) ORDER BY pos) AS t FROM hl GROUP BY key),
ct AS (SELECT key, string_agg(pos || '. item ' || item || CASE WHEN m IS NULL THEN '' ELSE chr(10) || '   [Matches: ' || m || ']' END, chr(10) ORDER BY pos) AS t FROM (
  SELECT cl.key, cl.pos, cl.item, (SELECT string_agg(x.tag, ', ' ORDER BY x.i) FROM (SELECT tag, min(i) AS i FROM (SELECT unnest(tags[3:4]) AS tag, unnest([1, 2]) AS i FROM base_tags WHERE item = cl.item AND item % 3 <> 0) GROUP BY tag) x JOIN hp ON hp.key = cl.key AND hp.tag = x.tag) AS m FROM cl) GROUP BY key)
SELECT s.key, replace(replace(replace(replace({_cases('domain', _RANKING)}, '{{summary}}', CASE WHEN hs.t IS NULL THEN '' ELSE 'My history shows these patterns:' || chr(10) || hs.t || chr(10) || chr(10) END), '{{history}}', ht.t), '{{candidates}}', ct.t), '{{n}}', len(c)::VARCHAR) AS prompt
FROM s JOIN ht USING (key) JOIN ct USING (key) LEFT JOIN hs USING (key)""")
def ranking_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histories and candidates of the events; the words of a part's name are the preferences of some items."""
    own = V.base_tags(spark, sf_dir).select("item", F.struct(F.concat(F.lit("item "), F.col("item").cast("string")).alias("text"), F.when(F.col("item") % 3 != 0, F.slice("tags", 3, 2)).alias("preferences")).alias("x"))
    s = seqs(spark, sf_dir).select(F.col("user").alias("key"), S.last_n(F.col("seq"), 5).alias("history"), F.slice("seq", 1, 4).alias("candidates"))
    out = s.select("key", F.element_at(F.array(*map(F.lit, _NAMES)), (1 + F.col("key") % 4).cast("int")).alias("domain"))
    for part in ("history", "candidates"):
        long = s.select("key", F.posexplode(part).alias("pos", "item")).join(own, "item").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"))
        out = out.join(long.select("key", F.transform("l", lambda y: y["x"]).alias(part)), "key")
    return M.ranking_prompts(out, spark)


@query("rank_scores_index", f"""WITH {V.SEQS_SQL}, c AS (SELECT "user" AS qid, list_distinct(seq) AS u, seq FROM seqs), l AS (SELECT qid, unnest(seq) AS pos, unnest(range(len(seq))) AS o FROM c), f AS (SELECT qid, pos, min(o) AS o FROM l WHERE pos < 20 GROUP BY 1, 2),
k AS (SELECT qid, pos, pos // 2 AS text, o FROM f QUALIFY row_number() OVER (PARTITION BY qid, pos // 2 ORDER BY o) = 1)
SELECT qid, 1000 + pos AS item, (20 - row_number() OVER (PARTITION BY qid ORDER BY o) + 1)::INT AS score FROM k""")
def rank_scores_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers that are the items of a history, one a line, read as indexes of 20 candidates of which two each have one text."""
    s = seqs(spark, sf_dir)
    answers = s.select(F.col("user").alias("qid"), F.array_join(F.transform("seq", lambda x: x.cast("string")), "\n").alias("answer"))
    pos = F.explode(F.sequence(F.lit(0), F.lit(19)))
    candidates = s.select(F.col("user").alias("qid"), pos.alias("pos")).select("qid", "pos", (1000 + F.col("pos")).alias("item"), F.floor(F.col("pos") / 2).cast("string").alias("text"))
    return X.ranked_by_index(answers, candidates, 20)
