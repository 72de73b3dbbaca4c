"""Stand-in corpora derived from the driver's TPC-H-like tables.

No driver table holds SQL text, questions paired with SQL, or database
schemas, so these builders turn the given tables into rows of the schemas the
profiling jobs expect (datapoints, predictions, schema relations, annotated
tokens, word lists). They do none of the profiling work themselves; every
feature is computed by the operators from the text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.schema_profile import schema_from_dataframes

# --- fixed values: tables of the stand-in databases, in order (columns come from the tables themselves) ---
SCHEMA_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
N_DATABASES = 5
# --- fixed values: extra dictionary words for schema explainability ---
DICTIONARY_EXTRA = ["name", "key", "size", "type", "brand", "date", "status", "total",
                    "price", "order", "line", "tax", "discount", "quantity"]
# --- fixed values: closed-class words (articles, prepositions, pronouns, conjunctions, auxiliaries) ---
CLOSED_CLASS = [
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "had", "has", "have", "he", "her", "his", "i", "in",
    "is", "it", "its", "not", "of", "on", "or", "she", "that", "the", "their", "they", "this", "to", "was", "we", "were",
    "which", "with", "you",
    "au", "aux", "avec", "ce", "dans", "de", "des", "du", "elle", "en", "est", "et", "il", "la", "le", "les", "ou", "par",
    "pas", "pour", "que", "qui", "sur", "un", "une",
    "auf", "das", "dem", "den", "der", "die", "ein", "eine", "er", "ich", "ist", "mit", "nicht", "sie", "und", "von", "zu",
    "como", "con", "del", "el", "los", "las", "no", "para", "por", "se", "su", "y",
]
MODELS = [0, 1, 2]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _gold_sql(o) -> "F.Column":
    """SQL text of one datapoint, chosen by o_orderkey % 20 (templates 11, 18 and 19 are rejected)."""
    key, cust, price, status = o("o_orderkey"), o("o_custkey"), o("o_totalprice"), o("o_orderstatus")
    fprice = F.floor(price).cast("bigint").cast("string")
    c = cust.cast("string")
    t = key % 20
    return (
        F.when(t == 0, F.concat(F.lit("select count(*) from orders where o_custkey = "), c))
        .when(t == 1, F.concat(F.lit("select o_orderkey, o_totalprice from orders where o_totalprice > "), fprice,
                               F.lit(" and o_orderstatus = '"), status,
                               F.lit("' order by o_totalprice desc limit 5")))
        .when(t == 2, F.concat(F.lit("select c.c_name, sum(o.o_totalprice) from customer as c join orders as o "
                                     "on c.c_custkey = o.o_custkey where c.c_custkey = "), c,
                               F.lit(" group by c.c_name")))
        .when(t == 3, F.concat(F.lit("select c_name from customer where c_custkey in (select o_custkey from orders "
                                     "where o_totalprice >= "), fprice, F.lit(")")))
        .when(t == 4, F.concat(F.lit("select distinct c_mktsegment from customer where c_acctbal between "), c,
                               F.lit(" and "), fprice, F.lit(" and c_nationkey != 3")))
        .when(t == 5, F.concat(F.lit("select n.n_name, count(*) from customer c, nation n where c.c_nationkey = "
                                     "n.n_nationkey group by n.n_name having count(*) > "),
                               (cust % 20).cast("string")))
        .when(t == 6, F.concat(F.lit("select c_name from customer where c_nationkey = "), (cust % 25).cast("string"),
                               F.lit(" union select s_name from supplier where s_nationkey = "),
                               (cust % 25).cast("string")))
        .when(t == 7, F.lit("select max(t.total) from (select sum(o_totalprice) as total from orders "
                            "group by o_custkey) as t"))
        .when(t == 8, F.concat(F.lit("select p_name from part where p_name like '%ring%' and p_size <> "),
                               (cust % 50).cast("string")))
        .when(t == 9, F.concat(F.lit("select l.l_orderkey from lineitem l left join orders o on l.l_orderkey = "
                                     "o.o_orderkey where o.o_orderkey is null or l.l_quantity * l.l_extendedprice > "),
                               fprice))
        .when(t == 10, F.lit("select o_orderkey from orders where o_custkey not in (select c_custkey from customer "
                             "where c_acctbal > (select avg(c_acctbal) from customer)) order by o_orderdate asc "
                             "limit 3"))
        .when(t == 11, F.lit("select count( from orders where"))
        .when(t == 12, F.concat(F.lit("with big as (select o_custkey from orders where o_totalprice > "), fprice,
                                F.lit(") select c.c_name from customer c inner join big b on c.c_custkey = b.o_custkey "
                                      "where c.c_acctbal < "), c))
        .when(t == 13, F.concat(F.lit("select p_name from part where p_size <= "), (cust % 50).cast("string"),
                                F.lit(" and not (p_retailprice not between 10 and "), c,
                                F.lit(") and p_brand ilike 'b%' intersect select p_name from part where p_type not like "
                                      "'%''s%' or p_retailprice / 2 > "), c))
        .when(t == 14, F.lit('select "c"."c_name", min(c.c_acctbal - 1.5e1), max(c.c_acctbal + .5) from customer "c" '
                             'cross join region r group by "c"."c_name" order by "c"."c_name" desc, c.c_acctbal'))
        .when(t == 15, F.lit("select s_name from supplier where s_name is not null except select s_name from supplier "
                             "where exists (select n_nationkey from nation where n_name = \" RUSSIA \" -- isn't read\n)"))
        .when(t == 16, F.concat(F.lit("select o_orderkey, case when o_totalprice > "), fprice,
                                F.lit(" then 'big' else 'small' end as größe from orders o left outer join customer c "
                                      "on o.o_custkey = c.c_custkey group by o_orderkey, c.c_name")))
        .when(t == 17, F.lit("select count(distinct o_custkey) from orders /* all's well */ union all "
                             "select upper(c_name) from customer"))
        .when(t == 18, F.lit("select count(*) from customer group by c_nationkey + 1"))
        .otherwise(F.lit("select c_name from customer where c_custkey = ?"))
    )


def user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn: (conv_id, turn_no, turns, question), numbered from 0 within its conversation."""
    conv = table(spark, sf_dir, "conversations").where((F.col("role") == "user") & F.col("conv_id").isNotNull())
    w = Window.partitionBy("conv_id")
    return conv.select("conv_id", (F.row_number().over(w.orderBy("turn", "text")) - 1).cast("long").alias("turn_no"),
                       F.count(F.lit(1)).over(w).alias("turns"), F.col("text").alias("question"))


def datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One datapoint per order (FIXTURES B1).

    Columns: datapoint_id, dataset, split, db_id, db_path, question, sql_query.
    Order k asks the question of conversation ``k % n`` (n = max conv_id + 1, a scalar subquery), user turn
    ``floor(k / n) % turns``: a key join, no global ordering, and all user turns come up. Orders travel as keys, their SQL
    is made after the joins; a turn is unique by its grouping, so Spark leaves the joins out where no question is asked for.
    """
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user")
    o = o.withColumn("n_conv", conv.agg(F.max("conv_id") + 1).scalar())
    q = user_questions(spark, sf_dir)
    turns = q.groupBy("conv_id").agg(F.max("turns").alias("turns"))
    q = q.groupBy("conv_id", "turn_no").agg(F.first("question").alias("question"))
    dp = o.select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % F.col("n_conv")).alias("conv_id"),
        F.floor(F.col("o_orderkey") / F.col("n_conv")).alias("pass_no"))
    dp = dp.join(turns, "conv_id", "left").withColumn("turn_no", F.col("pass_no") % F.col("turns")).drop("turns")
    dp = dp.join(q, ["conv_id", "turn_no"], "left").select(
        F.col("o_orderkey").alias("datapoint_id"),
        F.col("o_orderstatus").alias("dataset"),
        F.when(F.col("o_orderkey") % 10 == 0, "test").when(F.col("o_orderkey") % 10 == 1, "dev")
        .otherwise("train").alias("split"),
        F.concat(F.lit("db_"), (F.col("o_custkey") % N_DATABASES).cast("string")).alias("db_id"),
        "question", _gold_sql(F.col).alias("sql_query"),
    )
    return dp.withColumn("db_path", F.concat(F.lit("databases/"), F.col("db_id"), F.lit(".json"))).select(
        "datapoint_id", "dataset", "split", "db_id", "db_path", "question", "sql_query")


def predicted_sql(g, key, m):
    """Model m's prediction for gold SQL g of datapoint key (FIXTURES B2)."""
    v = (F.floor(key / 12).cast("bigint") + m) % 5
    return (
        F.when(v == 0, g)
        .when(v == 1, F.replace(F.replace(g, F.lit(" > "), F.lit(" >= ")), F.lit(" = "), F.lit(" != ")))
        .when(v == 2, F.replace(F.replace(g, F.lit(" and "), F.lit(" or ")), F.lit("count(*)"),
                                F.lit("sum(o_custkey)")))
        .when(v == 3, F.concat(g, F.lit(" limit 3")))
        .otherwise(F.replace(F.replace(g, F.lit("select "), F.lit("select distinct ")), F.lit(" asc"),
                             F.lit(" desc")))
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """datapoints x models: (datapoint_id, dataset, split, db_id, model, m, gold, predicted)."""
    dp = datapoints(spark, sf_dir)
    dp = dp.withColumn("m", F.explode(F.array(*[F.lit(m) for m in MODELS])))  # 3 models per datapoint
    return dp.select(
        "datapoint_id", "dataset", "split", "db_id", "db_path", "question",
        F.concat(F.lit("m"), F.col("m").cast("string")).alias("model"), "m",
        F.col("sql_query").alias("gold"),
        predicted_sql(F.col("sql_query"), F.col("datapoint_id"), F.col("m")).alias("predicted"),
    )


def foreign_keys(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """Named foreign keys of the stand-in databases: column ``x_<stem>key`` refers to the ``<stem>key`` column of
    the other table whose name starts with the stem."""
    c = columns.where("table_idx >= 0").join(tables.select("db_id", "table_idx", "table_name"), ["db_id", "table_idx"]) \
        .select("db_id", "table_name", "column_name", F.regexp_extract("column_name", "_([a-z]+)key$", 1).alias("stem")).where("stem <> ''")
    pk = c.where(F.col("table_name").startswith(F.col("stem"))).select("db_id", "stem", F.col("table_name").alias("pk_table"), F.col("column_name").alias("pk_column"))
    return c.join(pk, ["db_id", "stem"]).where("table_name <> pk_table") \
        .select("db_id", F.col("table_name").alias("fk_table"), F.col("column_name").alias("fk_column"), "pk_table", "pk_column")


def schema_relations(spark: SparkSession, sf_dir: str):
    """(schema_tables, schema_columns, schema_fk_names) of five stand-in databases (FIXTURES B3): db_k holds the given
    tables but the last k, read through D2 from the tables' own schemas; rows per table are ``count(*)``. Foreign
    keys are named on the columns of the whole database, so some lead to tables that db_k lacks."""
    frames = {t: table(spark, sf_dir, t) for t in SCHEMA_TABLES}
    tables, columns = schema_from_dataframes(spark, "db", frames)
    databases = F.explode(F.array(*[F.lit(k) for k in range(N_DATABASES)]))
    fks = foreign_keys(tables, columns)

    def spread(df):
        return df.withColumn("k", databases).withColumn("db_id", F.concat(F.lit("db_"), F.col("k").cast("string")))

    st, sc = (spread(df).where(F.col("table_idx") < len(SCHEMA_TABLES) - F.col("k")).drop("k") for df in (tables, columns))
    return st, sc, spread(fks).drop("k")


def text_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to profile (FIXTURES B4): documents (dataset = lang, split = source) and user turns.

    Columns: text_id string, dataset, split, text.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text_id"),
        F.col("lang").alias("dataset"), F.col("source").alias("split"), "text")
    conv = table(spark, sf_dir, "conversations").where(F.col("role") == "user").select(
        F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
        .alias("text_id"), F.lit("conversations").alias("dataset"), F.lit("user").alias("split"), "text")
    return docs.unionByName(conv)


def reference_frequency_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference word list (FIXTURES B6): all lower-cased forms of ``documents`` with their tag (as in B5) and frequency."""
    return table(spark, sf_dir, "documents").select(
        F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("form")) \
        .groupBy("form").agg(F.count(F.lit(1)).alias("freq")) \
        .select("form", F.when(F.col("form").isin(CLOSED_CLASS), "CLOSED").otherwise("OPEN").alias("upos"), "freq")


def dictionary_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary for schema explainability (FIXTURES B6): words of region/nation names + fixed list."""
    words = None
    for tname, col in (("region", "r_name"), ("nation", "n_name")):
        w = table(spark, sf_dir, tname).select(
            F.explode(F.regexp_extract_all(F.lower(col), F.lit(r"\p{L}+"), 0)).alias("word"))
        words = w if words is None else words.unionByName(w)
    extra = spark.createDataFrame([(w,) for w in DICTIONARY_EXTRA], "word string")
    return words.unionByName(extra).distinct()


def annotated_tokens(spark: SparkSession, sf_dir: str, texts: DataFrame | None = None) -> DataFrame:
    """Annotated token table (FIXTURES B5) standing in for a tagger/parser's output.

    (text_id, sent_id, tok_id, form, lemma, upos, head): sentences end at . ! ? or a line
    break, tok_id is 1-based in the sentence, head = floor(tok_id / 2) (0 = root), upos is
    CLOSED for the words of ``CLOSED_CLASS``, else OPEN.
    """
    texts = texts if texts is not None else text_inputs(spark, sf_dir)
    sents = texts.select("text_id", F.posexplode(F.split("text", r"[.!?\n]+")).alias("sent_id", "sent"))
    toks = sents.select("text_id", "sent_id",
                        F.posexplode(F.regexp_extract_all("sent", F.lit(r"\p{L}+"), 0)).alias("p", "form"))
    return toks.select(
        "text_id", "sent_id", (F.col("p") + 1).alias("tok_id"), "form",
        F.lower("form").alias("lemma"), F.when(F.lower("form").isin(CLOSED_CLASS), "CLOSED").otherwise("OPEN").alias("upos"),
        F.floor((F.col("p") + 1) / 2).cast("int").alias("head"))
