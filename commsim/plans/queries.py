"""Every operator as a query over the test tables.

Results are flat: arrays become sorted strings, counts are bigint, scores are rounded to six places.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.feature import Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from commsim import sources
from commsim.operators import baskets, filters, fuse, index, meta, names, pairs, text
from commsim.plans import pipelines, tables
from commsim.session import materialize, shared_path

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the filter queries and of the reports on single communities.
TEN_SOURCES = ["src0", "src1", "src2", "src3", "src5", "src8", "src13", "src17", "src18", "src19"]
JOINED_SOURCES = "src0,src1,src2,src3,src4,src5,src6,src7,src8,src9,src10,src11,src12,src13,src14"
ONE_SOURCE = "src0"
LISTED_SOURCES = [f"src{7 * k % 20}" for k in range(20)]
ALLOWED_BRANDS = [f"Brand#{k}" for k in range(1, 26) if k % 4]
LISTED_BRANDS = [f"Brand#{k}" for k in range(25, 0, -1)]
ITEM_SUPPORT = 1000
PAIR_SUPPORT = 900
SET_SHARE = 0.55
SET_SIZE = 3
FIRST_ROWS = 10
FIRST_PAGES = 8
VECTOR_BLOCK = 1024

_QUERIES: dict[str, Query] = {}


def _query(run: Query) -> Query:
    _QUERIES[run.__name__] = run
    return run


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def _round(column: str | Column) -> Column:
    return F.round(column, 6)


def _joined(column: str, separator: str = "|") -> Column:
    return F.array_join(column, separator)


# Sources and sinks


@_query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "posts")
    sources.write_json(tables.posts(spark, sf_dir), path)
    return sources.read_json(spark, path, sources.POSTS)


@_query
def parquet_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "filtered")
    sources.write_parquet(filters.in_values(tables.posts(spark, sf_dir), "subreddit", TEN_SOURCES), path)
    return sources.read_parquet(spark, path)


@_query
def components_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "components")
    sources.write_json(ngram_components(spark, sf_dir), path)
    return sources.read_json(spark, path, sources.COMPONENTS).select("subreddit", "index")


@_query
def basket_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "baskets")
    edges = baskets.author_edges(tables.purchases(spark, sf_dir), allowed=_allowed_brands(spark, sf_dir))
    sources.write_baskets(baskets.author_baskets(edges), path)
    transactions = sources.read_baskets(spark, path).select(_joined("communities").alias("communities"))
    return transactions.groupBy("communities").agg(F.count("*").alias("authors"))


def _metadata_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "metadata")
    sources.write_metadata(tables.nation_metadata(spark, sf_dir), path, order="place")
    return sources.read_metadata(spark, path, placed=True)


@_query
def meta_csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _metadata_file(spark, sf_dir).drop("place")


@_query
def meta_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of a plain metadata file, in which the nations stand in the order of their keys."""
    return meta.first_rows(_metadata_file(spark, sf_dir), FIRST_ROWS)


@_query
def scores_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "scores")
    sources.write_json(user_cosine(spark, sf_dir), path)
    return sources.read_pair_scores(spark, path)


# Filters


@_query
def filter_inlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return filters.in_values(documents, "source", TEN_SOURCES)


@_query
def filter_inset(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = tables.table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return filters.in_joined_values(documents, "source", JOINED_SOURCES)


@_query
def filter_not_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = tables.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return filters.not_value(orders, "o_orderpriority", "5-LOW")


@_query
def allowlist_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts of the communities on a stored list: those whose documents are longer than 2,400 characters on average."""
    documents = tables.table(spark, sf_dir, "documents")
    sizes = documents.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    path = shared_path(spark, "allowlist")
    sources.write_lines(sizes.where(F.col("chars") > F.col("n") * 2400).select("source"), path)
    posts = documents.select("doc_id", "source", "n_chars")
    return filters.in_list(posts, "source", sources.read_lines(spark, path))


def _listing(spark: SparkSession, sf_dir: str, num_pages: int | None = None) -> DataFrame:
    found = filters.listing_entries(
        tables.table(spark, sf_dir, "pages"),
        number="page_id",
        html="html",
        begin="<nav>",
        end="</nav>",
        entry="<a [^>]*>",
        flag='href="(/)[a-z]',
        flag_value="/",
        name='href="/([^"]*)"',
        num_pages=num_pages,
    )
    return found.select("page_id", F.col("position").cast("long").alias("position"), "name")


@_query
def page_listing_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir)


@_query
def page_listing_first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _listing(spark, sf_dir, FIRST_PAGES)


# Text


@_query
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.token_rows(tables.texts(spark, sf_dir), "doc_id", "subreddit")
    return rows.select("doc_id", "subreddit", _joined("tokens", " ").alias("tokens"))


@_query
def tokenize_keep_last_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = tables.table(spark, sf_dir, "conversations")
    rows = text.token_rows(turns, "conv_id", "turn", title="text", keep_last_char=True)
    return rows.select("conv_id", "turn", _joined("tokens", " ").alias("tokens"))


@_query
def ngrams_per_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = text.ngram_rows(tables.texts(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.size("ngrams").cast("long").alias("n"), _joined("ngrams").alias("ngrams"))


@_query
def ngram_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.posts_to_edges(tables.texts(spark, sf_dir))


# Vocabularies, indexes, components and vectors


@_query
def ngram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.ngram_occurrences(tables.texts(spark, sf_dir)).distinct()


@_query
def ngram_vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_vocab(spark, sf_dir).agg(F.count("*").alias("size"))


@_query
def ngram_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dense_index(text.ngram_occurrences(tables.texts(spark, sf_dir)), "ngram").frame


@_query
def ngram_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.posts_to_components(tables.texts(spark, sf_dir))


@_query
def user_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.purchases(spark, sf_dir).select(F.col("author").alias("user")).distinct()


@_query
def user_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.dense_index(tables.purchases(spark, sf_dir).select(F.col("author").alias("user")), "user").frame


@_query
def user_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = tables.purchases(spark, sf_dir).select("subreddit", F.col("author").alias("user"))
    return index.repeated_components(edges, index.dense_index(edges, "user"), "user")


@_query
def community_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The components of one community, as a pairwise report reads them."""
    return ngram_components(spark, sf_dir).where(F.col("subreddit") == ONE_SOURCE).select("index")


@_query
def community_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    posts = tables.texts(spark, sf_dir)
    vectors = pipelines.posts_to_vectors(posts, pairs.community_index(posts), VECTOR_BLOCK)
    return vectors.select("subreddit", "block", "size", _joined("indices", ",").alias("indices"))


@_query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector blocks as ML vectors, through an ML transformer: entries of each block, and their common value after scaling to length 1."""
    edges = tables.purchases(spark, sf_dir).select("subreddit", F.col("author").alias("user")).where("user IS NOT NULL").distinct()
    edges = materialize(edges, "edges")
    users = index.dense_index(edges, "user")
    blocks = index.community_vectors(index.components(edges, users, "user"), users.size, VECTOR_BLOCK)
    scaled = Normalizer(p=2.0, inputCol="vector", outputCol="scaled").transform(index.ml_vectors(blocks, users.size, VECTOR_BLOCK))
    entries = F.filter(vector_to_array("scaled"), lambda x: x > 0)
    return scaled.select("subreddit", "block", F.col("length").cast("long").alias("length"), F.size(entries).cast("long").alias("entries"), _round(F.array_max(entries)).alias("scaled"))


# Pairs of communities


@_query
def pair_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.pair_spine(tables.given_list(spark, _present_sources(spark, sf_dir)))


@_query
def directed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.directed_pairs(tables.given_list(spark, _present_sources(spark, sf_dir)))


def _present_sources(spark: SparkSession, sf_dir: str) -> list[str]:
    """The caller's list without the names that have no document; at most as long as the list."""
    found = filters.in_values(tables.source_names(spark, sf_dir), "name", LISTED_SOURCES).collect()
    present = {r.name for r in found}
    return [name for name in LISTED_SOURCES if name in present]


def _two_vocabularies(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    turns = tables.table(spark, sf_dir, "conversations")
    return text.ngram_occurrences(tables.texts(spark, sf_dir)), text.ngram_occurrences(turns, title="text")


@_query
def set_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.set_union(*_two_vocabularies(spark, sf_dir))


@_query
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.set_intersect(*_two_vocabularies(spark, sf_dir))


JACCARD = ("s1", "s2", "n1", "n2", "common")


@_query
def ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities = tables.given_list(spark, _present_sources(spark, sf_dir))
    scores = pairs.jaccard(pipelines.ngram_overlaps(tables.texts(spark, sf_dir), communities), communities)
    return scores.select(*JACCARD, _round("jaccard").alias("jaccard"))


@_query
def user_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities = tables.given_list(spark, LISTED_BRANDS)
    scores = pairs.jaccard(pipelines.author_overlaps(tables.purchases(spark, sf_dir), communities), communities)
    return scores.select(*JACCARD, _round("jaccard").alias("jaccard"))


@_query
def user_jaccard_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a list: suppliers that share customers. Pairs that share nothing have no row."""
    posts = tables.supplies(spark, sf_dir)
    communities = pairs.community_index(posts)
    scores = pairs.sharing_jaccard(pipelines.author_overlaps(posts, communities), communities)
    return scores.select(*JACCARD, _round("jaccard").alias("jaccard"))


@_query
def component_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jaccard from components that were saved and read again."""
    communities = tables.given_list(spark, _present_sources(spark, sf_dir))
    saved = components_roundtrip(spark, sf_dir)
    scores = pairs.jaccard(pairs.pair_overlaps(saved, communities, "index"), communities)
    return scores.select(*JACCARD, _round("jaccard").alias("jaccard"))


@_query
def text_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities = tables.given_list(spark, _present_sources(spark, sf_dir))
    grams = pipelines.ngram_overlaps(tables.texts(spark, sf_dir), communities)
    authors = pipelines.author_overlaps(tables.posts(spark, sf_dir), communities)
    scores = pipelines.text_scores(grams, authors, communities)
    return scores.select("s1", "s2", _round("ngram").alias("ngram"), _round("user").alias("user"))


# Baskets and user scores


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.table(spark, sf_dir, "part").select(F.col("p_brand").alias("subreddit"))


def _allowed_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored allow-list of brands, through a text file; it bounds every basket."""
    path = shared_path(spark, "allowlist")
    sources.write_lines(spark.createDataFrame([(b,) for b in ALLOWED_BRANDS], "name string"), path)
    return sources.read_lines(spark, path)


@_query
def author_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = _allowed_brands(spark, sf_dir)
    lists = baskets.author_baskets(baskets.author_edges(tables.purchases(spark, sf_dir), allowed=allowed))
    return lists.select("author", _joined("communities").alias("communities"))


@_query
def frequent_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets.item_counts(baskets.author_edges(tables.purchases(spark, sf_dir)), ITEM_SUPPORT)


@_query
def basket_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = _allowed_brands(spark, sf_dir)
    edges = materialize(baskets.author_edges(tables.purchases(spark, sf_dir), allowed=allowed), "edges")
    items = materialize(baskets.item_counts(edges, ITEM_SUPPORT), "items")
    lists = baskets.author_baskets(baskets.prune(edges, items))
    return lists.select("author", _joined("communities").alias("communities"))


def _user_pairs(spark: SparkSession, sf_dir: str, support: float = 0.0) -> DataFrame:
    communities = pairs.community_index(_brands(spark, sf_dir))
    return pipelines.user_pairs(tables.purchases(spark, sf_dir), communities, support)


@_query
def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_pairs(spark, sf_dir).select("s1", "s2", "freq")


@_query
def pair_support_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _user_pairs(spark, sf_dir, PAIR_SUPPORT).select("s1", "s2", "freq")


@_query
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of up to three brands that a given share of all customers order from."""
    edges = baskets.author_edges(tables.purchases(spark, sf_dir))
    customers = tables.table(spark, sf_dir, "customer").count()
    found = baskets.frequent_itemsets(edges, max(1, math.ceil(customers * SET_SHARE)), SET_SIZE)
    return found.select("size", _joined("items").alias("items"), "freq")


@_query
def assoc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = baskets.association_rules(_user_pairs(spark, sf_dir))
    return rules.withColumn("confidence", _round("confidence"))


@_query
def user_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baskets.user_cosine(_user_pairs(spark, sf_dir)).withColumn("score", _round("score"))


# Names


@_query
def name_lcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.name_lcs(pairs.community_index(tables.part_names(spark, sf_dir), "name"))


@_query
def affix_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.mine_affixes(tables.typed_part_names(spark, sf_dir))


def _part_affixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    affixes = tables.affix_list(spark, names.mine_affixes(tables.typed_part_names(spark, sf_dir)))
    return names.tag_affixes(tables.part_names(spark, sf_dir), affixes)


@_query
def affix_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_affixes(spark, sf_dir)


# Metadata


@_query
def mention_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.mentions(tables.wiki_texts(spark, sf_dir))


@_query
def mention_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.joined_lists(tables.nation_mentions(spark, sf_dir), "name", "mention", "mentions")


@_query
def mod_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return meta.joined_lists(tables.nation_mods(spark, sf_dir), "name", "mod", "mods")


@_query
def meta_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.nation_metadata(spark, sf_dir).drop("place")


def _affix_scores(spark: SparkSession, sf_dir: str, any_affix: bool) -> DataFrame:
    listed = tables.part_names(spark, sf_dir).distinct()
    affixes = names.affix_edges(listed, tables.affix_list(spark, names.mine_affixes(tables.typed_part_names(spark, sf_dir))))
    communities = pairs.community_index(listed, "name")
    wanted = materialize(pairs.directed_pairs(communities), "pairs")
    scored = meta.affix_scores(affixes, communities, tables.word_list(spark, listed), any_affix, wanted)
    return meta.on_pairs(communities, scored, pairs=wanted).select("s1", "s2", F.col("affix").alias("score"))


@_query
def affix_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affix_scores(spark, sf_dir, any_affix=False)


@_query
def affix_similarity_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _affix_scores(spark, sf_dir, any_affix=True)


@_query
def mod_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities, mods = tables.nation_index(spark, sf_dir), materialize(tables.nation_mods(spark, sf_dir), "mods")
    overlap = meta.moderator_scores(mods, communities, set_overlap=True).withColumnRenamed("moderator", "overlap")
    scored = meta.on_pairs(communities, meta.moderator_scores(mods, communities), overlap)
    return scored.select("s1", "s2", _round("moderator").alias("score"), _round("overlap").alias("overlap_score"))


@_query
def wiki_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    communities, mentioned = tables.nation_index(spark, sf_dir), materialize(tables.nation_mentions(spark, sf_dir), "mentions")
    common = meta.mention_scores(mentioned, communities, co_mention=True).withColumnRenamed("mention", "co_mention_score")
    scored = meta.on_pairs(communities, meta.mention_scores(mentioned, communities), common)
    return scored.select("s1", "s2", F.col("mention").alias("score"), "co_mention_score")


@_query
def meta_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = tables.nations(spark, sf_dir)
    scores = meta.meta_scores(
        names.affix_edges(named, tables.nation_affix_list(spark, sf_dir)),
        tables.nation_mods(spark, sf_dir),
        tables.nation_mentions(spark, sf_dir),
        tables.nation_index(spark, sf_dir),
        tables.nation_words(spark, sf_dir),
    )
    return scores.select("s1", "s2", "affix", "mention", _round("moderator").alias("moderator"), _round("score").alias("score"))


# Fusion


@_query
def pair_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last trade between two nations, whichever of them sells: order lines name a pair in both orientations."""
    entries = tables.trades(spark, sf_dir)
    first = fuse.one_per_pair(entries, "score", keep="first").withColumnRenamed("score", "first")
    last = fuse.one_per_pair(entries, "score", keep="last").withColumnRenamed("score", "last")
    return first.join(last, ["a", "b"])


@_query
def fuse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = tables.written_events(spark, sf_dir)
    scores = pipelines.fused_scores(
        tables.texts(spark, sf_dir),
        tables.posts_of(events),
        tables.source_affixes(spark, sf_dir),
        tables.source_mods(events),
        tables.source_mentions(spark, sf_dir, events),
        tables.word_list(spark, tables.source_names(spark, sf_dir)),
        tables.given_list(spark, _present_sources(spark, sf_dir)),
    )
    return scores.select("s1", "s2", *[_round(c).alias(c) for c in ("text", "user", "meta", "total")])


@_query
def fuse_score_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three reports written as files of one JSON array each, read back in their order and fused."""
    events, communities = tables.written_events(spark, sf_dir), tables.given_list(spark, _present_sources(spark, sf_dir))
    posts = tables.posts_of(events)
    authors = pipelines.author_overlaps(posts, communities)
    text = pipelines.text_scores(pipelines.ngram_overlaps(tables.texts(spark, sf_dir), communities), authors, communities)
    user = pipelines.user_scores(posts, communities)
    directed = meta.meta_scores(
        tables.source_affixes(spark, sf_dir),
        tables.source_mods(events),
        tables.source_mentions(spark, sf_dir, events),
        communities,
        tables.word_list(spark, tables.source_names(spark, sf_dir)),
    )
    reports = (
        (text.select("i", "j", "s1", "s2", "ngram", "user"), ("i", "j"), sources.TEXT_SCORES),
        (user.select("s1", "s2", "score"), ("s1", "s2"), sources.SCORES),
        (directed.select("i", "j", "s1", "s2", "score"), ("i", "j"), sources.SCORES),
    )
    read = []
    for report, order, schema in reports:
        path = shared_path(spark, "report")
        sources.write_score_array(report, path, *order)
        read.append(sources.read_score_arrays(spark, path, schema))
    return fuse.fuse(communities, *read).select("s1", "s2", *[_round(c).alias(c) for c in ("text", "user", "meta", "total")])
