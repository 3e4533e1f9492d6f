"""The pipeline's inputs, derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commsim import sources
from commsim.operators import meta, names
from commsim.operators.index import DenseIndex
from commsim.operators.pairs import community_index
from commsim.session import materialize, shared_path

DELETED = "[deleted]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sources.read_parquet(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without authors: a document's source is its community."""
    documents = table(spark, sf_dir, "documents")
    return documents.select("doc_id", F.col("source").alias("subreddit"), F.col("text").alias("title"))


def event_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a post below a document, dealt by remainder: ``(doc_id, subreddit, author, event_type, props)``.

    Error events stand for deleted authors.
    """
    documents = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("subreddit"))
    author = F.when(F.col("event_type") == "error", DELETED).otherwise(F.col("user_id").cast("string"))
    events = table(spark, sf_dir, "events").select(
        F.pmod("event_id", F.lit(documents.count())).alias("doc_id"), author.alias("author"), "event_type", "props"
    )
    return events.join(documents, "doc_id")


def written_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """:func:`event_posts`, written for pipelines that read them more than once."""
    return materialize(event_posts(spark, sf_dir), "events")


def posts_of(events: DataFrame) -> DataFrame:
    """Posts with authors: ``(subreddit, title, author)``, one for every event; titles are short."""
    return events.select("subreddit", F.col("props").alias("title"), "author")


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts_of(event_posts(spark, sf_dir))


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without titles: customers are authors, the brands they order are communities; low-priority
    orders stand for deleted authors."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("subreddit"))
    author = F.when(F.col("o_orderpriority") == "5-LOW", DELETED).otherwise(F.col("o_custkey").cast("string"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), author.alias("author"))
    return lines.join(parts, "l_partkey").join(orders, "l_orderkey").select("subreddit", "author")


def supplies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts without titles: customers are authors, the suppliers they order from are communities. Written, as they are read twice."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    joined = materialize(lines.join(orders, "l_orderkey").select("l_suppkey", "o_custkey"), "supplies")
    return joined.select(F.col("l_suppkey").cast("string").alias("subreddit"), F.col("o_custkey").cast("string").alias("author"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of two words."""
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"))


def typed_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of three words."""
    return table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", "p_name").alias("name"))


def affix_list(spark: SparkSession, mined: DataFrame) -> DataFrame:
    """A mined affix list after its way through a text file; affixes may begin or end with spaces."""
    path = shared_path(spark, "affixes")
    sources.write_lines(mined.select("affix"), path)
    return sources.read_lines(spark, path, "affix", trim=False)


def word_list(spark: SparkSession, lines: DataFrame) -> DataFrame:
    """The words of a column, written as a text file and read as a dictionary."""
    path = shared_path(spark, "words")
    sources.write_lines(lines, path)
    return materialize(sources.read_words(spark, path), "words")


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as communities: ``(key, name)``."""
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey")
    named = nation.join(table(spark, sf_dir, "region"), "r_regionkey")
    name = F.lower(F.concat_ws("_", F.replace("r_name", F.lit(" "), F.lit("_")), "n_name"))
    return named.select(F.col("n_nationkey").alias("key"), name.alias("name"))


def nation_mods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderators ``(name, mod)`` of a nation: segment and balance class of each of its customers."""
    balance = F.floor(F.col("c_acctbal") / 1000).cast("string")
    rows = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("key"), F.concat_ws("_", "c_mktsegment", balance).alias("mod")
    )
    return rows.distinct().join(nations(spark, sf_dir), "key").select("name", "mod")


def nation_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions ``(name, mention)`` of a nation: where the order lines of its customers come from."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("s_suppkey"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("key"))
    origin = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("origin"))
    bought = lines.join(orders, "o_orderkey").join(customers, "c_custkey").join(origin, "s_suppkey").select("key", "origin").distinct()
    named = nations(spark, sf_dir)
    mentioned = bought.join(named.select(F.col("key").alias("origin"), F.col("name").alias("mention")), "origin")
    return mentioned.join(named, "key").select("name", "mention")


def nation_affix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affix_list(spark, names.mine_affixes(nations(spark, sf_dir)))


def nation_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of all nations in the order of their keys, which ``place`` carries."""
    named = nations(spark, sf_dir)
    lists = meta.assemble(
        named,
        names.tag_affixes(named, nation_affix_list(spark, sf_dir)),
        meta.joined_lists(nation_mods(spark, sf_dir), "name", "mod", "mods"),
        meta.joined_lists(nation_mentions(spark, sf_dir), "name", "mention", "mentions"),
    )
    return materialize(lists.join(named.select("name", F.col("key").cast("long").alias("place")), "name"), "metadata")


def nation_index(spark: SparkSession, sf_dir: str) -> DenseIndex:
    """The nations as a given list, in the order of their keys."""
    return community_index(nations(spark, sf_dir), "name", order="key")


def nation_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = nations(spark, sf_dir).select(F.concat_ws(" ", F.regexp_extract("name", "_(nation_.*)", 1), F.regexp_extract("name", "(_nation_.*)", 1)))
    return word_list(spark, lines)


def wiki_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wiki pages ``(name, text)``: a page's language is its community, its links become mentions."""
    html = table(spark, sf_dir, "pages").select("html")
    return html.select(
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("name"),
        F.regexp_replace("html", 'href="/([^"]*)"', "r/$1/about ").alias("text"),
    )


def source_mods(events: DataFrame) -> DataFrame:
    """Moderators ``(name, mod)`` of a source: the event types below its documents."""
    return events.select(F.col("subreddit").alias("name"), F.col("event_type").alias("mod")).distinct()


def source_mentions(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Mentions ``(name, mention)`` of a source: each event below its documents names a document by number, whose source is mentioned."""
    link = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    linked = events.select(F.col("subreddit").alias("name"), link.alias("link")).distinct()
    targets = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("link"), F.col("source").alias("mention"))
    return linked.join(targets, "link").select("name", "mention").distinct()


def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("name")).distinct()


def source_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(name, affix)`` of the affixes mined from the sources' names."""
    named = materialize(source_names(spark, sf_dir), "names")
    return names.affix_edges(named, affix_list(spark, names.mine_affixes(named)))


def given_list(spark: SparkSession, listed: list[str]) -> DenseIndex:
    """A caller's list of communities in its own order."""
    places = {name: i for i, name in enumerate(dict.fromkeys(listed))}
    return DenseIndex(spark.createDataFrame(list(places.items()), "community string, ord long"), len(places))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pair entries ``(s1, s2, score, ord)``: buyer's nation, seller's nation, price, and place among all order lines."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"), "l_extendedprice"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    buyers = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("NATION_"), "c_nationkey").alias("s1"))
    sellers = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("NATION_"), "s_nationkey").alias("s2"))
    joined = lines.join(orders, "o_orderkey").join(buyers, "c_custkey").join(sellers, "s_suppkey")
    return joined.select(
        "s1", "s2", F.col("l_extendedprice").alias("score"), F.struct("o_orderkey", "l_linenumber", "l_partkey", "s_suppkey", "l_extendedprice").alias("ord")
    )
