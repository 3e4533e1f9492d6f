"""Each query of :mod:`commsim.plans.queries` as one SQL statement over the same tables, for checking results."""

from __future__ import annotations

from commsim.plans.queries import (
    ALLOWED_BRANDS,
    FIRST_PAGES,
    FIRST_ROWS,
    ITEM_SUPPORT,
    JOINED_SOURCES,
    LISTED_BRANDS,
    LISTED_SOURCES,
    ONE_SOURCE,
    PAIR_SUPPORT,
    SET_SHARE,
    TEN_SOURCES,
    VECTOR_BLOCK,
)


def _with(body: str, *ctes: str) -> str:
    return f"WITH {', '.join(ctes)} {body}" if ctes else body


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Texts and grams


def _tokens(text: str, keep_last_char: bool = False) -> str:
    spaced = f"regexp_replace({text}, '[^A-Za-z0-9]', ' ', 'g')"
    if not keep_last_char:
        spaced = f"regexp_replace({spaced}, '(^| )[A-Za-z0-9]$', ' ')"
    return f"list_filter(string_split(lower({spaced}), ' '), lambda x: x <> '')"


def _grams(tokens: str) -> str:
    return (
        f"CASE WHEN len({tokens}) = 0 THEN CAST([] AS VARCHAR[]) "
        f"WHEN len({tokens}) <= 2 THEN [array_to_string({tokens}, ' ')] "
        f"ELSE list_transform(range(1, len({tokens})), lambda i: {tokens}[i] || ' ' || {tokens}[i + 1]) END"
    )


DOC_TOKENS = f"doc_tokens AS (SELECT doc_id, source AS subreddit, {_tokens('text')} AS tokens FROM documents)"
DOC_GRAMS = f"doc_grams AS (SELECT doc_id, subreddit, {_grams('tokens')} AS ngrams FROM doc_tokens)"
EDGES = "edges AS (SELECT DISTINCT subreddit, unnest(ngrams) AS ngram FROM doc_grams)"
TEXT = (DOC_TOKENS, DOC_GRAMS, EDGES)
NGRAM_IDS = """ids AS (SELECT ngram, row_number() OVER (ORDER BY ngram) - 1 AS "index" FROM (SELECT DISTINCT ngram FROM edges))"""
COMPONENTS = """parts AS (SELECT e.subreddit, i."index" FROM edges e JOIN ids i ON e.ngram = i.ngram)"""

# Authors

EVENT_POSTS = """event_posts AS (
    SELECT d.doc_id, d.source AS subreddit, event_type, props, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS link,
           CASE WHEN event_type = 'error' THEN '[deleted]' ELSE CAST(user_id AS VARCHAR) END AS author
    FROM events JOIN documents d ON d.doc_id = event_id % (SELECT count(*) FROM documents))"""
POSTS = "posts AS (SELECT subreddit, props AS title, author FROM event_posts)"
PURCHASES = """purchases AS (
    SELECT p_brand AS subreddit,
           CASE WHEN o_orderpriority = '5-LOW' THEN '[deleted]' ELSE CAST(o_custkey AS VARCHAR) END AS author
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
BASKET_EDGES = "basket_edges AS (SELECT DISTINCT author, subreddit FROM purchases WHERE author <> '[deleted]')"
ALLOWED_EDGES = f"allowed_edges AS (SELECT * FROM basket_edges WHERE subreddit IN ({_quoted(ALLOWED_BRANDS)}))"
SUPPLIES = """supplies AS (
    SELECT CAST(l_suppkey AS VARCHAR) AS subreddit, CAST(o_custkey AS VARCHAR) AS author
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
def _items(edges: str) -> str:
    return f"""items AS (
    SELECT subreddit AS item, count(*) AS freq FROM {edges} GROUP BY 1 HAVING count(*) >= {ITEM_SUPPORT})"""


def _baskets(edges: str) -> str:
    return f"SELECT author, string_agg(subreddit, '|' ORDER BY subreddit) AS communities FROM {edges} GROUP BY author"


# Pairs


def _pair_counts(name: str, edges: str, feature: str) -> tuple[str, ...]:
    """CTEs ``{name}_sizes(s, n)`` and ``{name}_common(s1, s2, common)`` of distinct edges."""
    return (
        f"{name}_features AS (SELECT DISTINCT subreddit AS s, {feature} AS f FROM {edges} WHERE {feature} IS NOT NULL)",
        f"{name}_sizes AS (SELECT s, count(*) AS n FROM {name}_features GROUP BY s)",
        f"""{name}_common AS (
            SELECT a.s AS s1, b.s AS s2, count(*) AS common
            FROM {name}_features a JOIN {name}_features b ON a.f = b.f AND a.s < b.s GROUP BY 1, 2)""",
    )


def _jaccard(name: str, ords: str = "ords") -> str:
    """Jaccard over the CTEs of :func:`_pair_counts`, for all pairs of the list ``ords(s, o)`` in its order."""
    return f"""
        SELECT x.s AS s1, y.s AS s2, x.n AS n1, y.n AS n2, coalesce(c.common, 0) AS common,
               coalesce(c.common, 0) / CAST(x.n + y.n - coalesce(c.common, 0) AS DOUBLE) AS jaccard
        FROM {name}_sizes x JOIN {ords} ox ON ox.s = x.s JOIN {ords} oy ON ox.o < oy.o JOIN {name}_sizes y ON y.s = oy.s
        LEFT JOIN {name}_common c ON c.s1 = least(x.s, y.s) AND c.s2 = greatest(x.s, y.s)"""


def _listed(names: list[str], present: str) -> str:
    """CTE ``ords(s, o)``: the places of a given list, without names absent from ``present(s)``."""
    values = ", ".join(f"('{n}', {i})" for i, n in enumerate(names))
    return f"""ords AS (
        SELECT s, row_number() OVER (ORDER BY place) - 1 AS o FROM (VALUES {values}) AS listed(s, place)
        WHERE s IN (SELECT s FROM ({present})))"""


def _user_pairs(name: str) -> str:
    return f"""{name} AS (
        SELECT c.s1, c.s2, x.n AS n1, y.n AS n2, c.common AS freq
        FROM basket_common c JOIN basket_sizes x ON c.s1 = x.s JOIN basket_sizes y ON c.s2 = y.s)"""


BASKET_PAIRS = (PURCHASES, BASKET_EDGES, *_pair_counts("basket", "basket_edges", "author"), _user_pairs("user_pairs"))
SOURCE_ORDS = _listed(LISTED_SOURCES, "SELECT source AS s FROM documents")
BRAND_ORDS = _listed(LISTED_BRANDS, "SELECT p_brand AS s FROM part")

# Names


def _lcs(name: str, names: str, column: str, min_length: int) -> tuple[str, ...]:
    """CTE ``{name}(a, b, lcs)``: longest common substring of ordered pairs that share one of ``min_length``."""
    return (
        f"{name}_names AS (SELECT DISTINCT {column} AS id, {column} AS txt FROM {names})",
        f"""{name}_starts AS (SELECT id, txt, unnest(range(0, len(txt))) AS pos FROM {name}_names)""",
        f"""{name}_subs AS (
            SELECT id, pos, len, substr(txt, pos + 1, len) AS sub
            FROM (SELECT id, txt, pos, unnest(range({min_length}, len(txt) - pos + 1)) AS len FROM {name}_starts))""",
        f"""{name} AS (
            SELECT a, b, sub AS lcs FROM (
                SELECT x.id AS a, y.id AS b, y.sub, row_number() OVER (
                    PARTITION BY x.id, y.id ORDER BY y.len DESC, x.pos - y.pos, y.pos) AS best
                FROM {name}_subs x JOIN {name}_subs y ON x.sub = y.sub AND x.pos >= y.pos AND x.id <> y.id)
            WHERE best = 1)""",
    )


def _mined(name: str, names: str) -> tuple[str, ...]:
    """CTE ``{name}(affix, freq)``: affixes of ``names(name)``; the names must stay different in lower case."""
    return (
        f"{name}_lower AS (SELECT DISTINCT lower(name) AS low FROM {names})",
        *_lcs(f"{name}_first", f"{name}_lower", "low", 4),
        f"{name}_cands AS (SELECT DISTINCT lcs FROM {name}_first)",
        *_lcs(f"{name}_second", f"{name}_cands", "lcs", 4),
        f"""{name} AS (
            SELECT lcs AS affix, count(*) AS freq FROM {name}_second WHERE lcs IN (SELECT lcs FROM {name}_cands)
            GROUP BY lcs HAVING count(*) > 0)""",
    )


def _tagged(name: str, names: str, affixes: str) -> str:
    return f"""{name} AS (
        SELECT n.name, coalesce(string_agg(a.affix, '|' ORDER BY a.affix), '') AS affixes
        FROM (SELECT DISTINCT name FROM {names}) n LEFT JOIN {affixes} a ON contains(n.name, a.affix) GROUP BY n.name)"""


PART_NAMES = "part_names AS (SELECT DISTINCT p_name AS name FROM part)"
TYPED_NAMES = "typed_names AS (SELECT DISTINCT p_type || ' ' || p_name AS name FROM part)"
PART_AFFIXES = (TYPED_NAMES, PART_NAMES, *_mined("mined", "typed_names"), _tagged("tagged", "part_names", "mined"))

# Metadata


def _lists(name: str, rows: str, value: str, joined: str) -> str:
    return f"""{name} AS (
        SELECT name, string_agg({value}, '|' ORDER BY {value}) AS {joined}
        FROM (SELECT DISTINCT name, {value} FROM {rows}) GROUP BY name)"""


def _metadata(name: str, names: str, affixes: str, mods: str, mentions: str) -> str:
    return f"""{name} AS (
        SELECT n.name, coalesce(a.affixes, '') AS affixes, coalesce(m.mods, '') AS mods, coalesce(w.mentions, '') AS mentions
        FROM {names} n LEFT JOIN {affixes} a ON a.name = n.name LEFT JOIN {mods} m ON m.name = n.name
        LEFT JOIN {mentions} w ON w.name = n.name)"""


NATIONS = """nations AS (
    SELECT n_nationkey AS key, lower(replace(r_name, ' ', '_') || '_' || n_name) AS name
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""
NATION_MODS = """nation_mods AS (
    SELECT DISTINCT n.name, c.c_mktsegment || '_' || CAST(CAST(floor(c.c_acctbal / 1000) AS BIGINT) AS VARCHAR) AS mod
    FROM nations n JOIN customer c ON c.c_nationkey = n.key)"""
NATION_MENTIONS = """nation_mentions AS (
    SELECT DISTINCT n.name, m.name AS mention
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey JOIN nations m ON s_nationkey = m.key JOIN nations n ON c_nationkey = n.key)"""
NATION_LISTS = (
    NATIONS,
    NATION_MODS,
    NATION_MENTIONS,
    _lists("mod_lists", "nation_mods", "mod", "mods"),
    _lists("mention_lists", "nation_mentions", "mention", "mentions"),
)
NATION_METADATA = (
    *NATION_LISTS,
    *_mined("mined", "nations"),
    _tagged("tagged", "nations", "mined"),
    _metadata("metadata", "nations", "tagged", "mod_lists", "mention_lists"),
)
NATION_WORDS = """words AS (
    SELECT lower(n_name) AS word FROM nation UNION SELECT '_' || lower(n_name) FROM nation)"""

AFFIXES_OF = "string_split(t.affixes, '|')"
MODS_OF = "string_split(t.mods, '|')"
MENTIONS_OF = "string_split(lower(t.mentions), '|')"
SHARED = "(contains(o.name, {0}) AND len({0}) > 3)"
LAST_AFFIX = SHARED.format(f"{AFFIXES_OF}[-1]")
ANY_AFFIX = f"len(list_filter({AFFIXES_OF}, lambda x: {SHARED.format('x')})) > 0"
MODERATOR = f"len(list_filter({MODS_OF}, lambda x: x = o.mods)) / CAST(len({MODS_OF}) AS DOUBLE)"
MODERATOR_OVERLAP = f"""len(list_intersect({MODS_OF}, string_split(o.mods, '|')))
    / CAST(len(list_distinct({MODS_OF})) AS DOUBLE)"""
# Community names and mentions of the test tables have more than one character, so the single-character case cannot occur.
MENTION = f"CASE WHEN list_contains({MENTIONS_OF}, lower(o.name)) THEN 1.0e0 ELSE 0.0e0 END"
CO_MENTION = f"""CASE WHEN list_contains({MENTIONS_OF}, lower(o.name)) THEN 1.0e0
    WHEN len(list_filter(list_intersect({MENTIONS_OF}, string_split(lower(o.mentions), '|')), lambda x: x <> '')) > 0
    THEN 0.5e0 ELSE 0.0e0 END"""


def _affix(hit: str) -> str:
    return f"CASE WHEN {hit} THEN 1.0e0 WHEN w.word IS NOT NULL THEN 0.5e0 ELSE 0.0e0 END"


def _meta_pairs(columns: str, metadata: str = "metadata", lcs: str = "lcs") -> str:
    """``columns`` over every ordered pair: ``t`` the target, ``o`` the other, ``w`` their common word."""
    return f"""SELECT t.name AS s1, o.name AS s2, {columns}
        FROM {metadata} t JOIN {metadata} o ON t.name <> o.name
        LEFT JOIN {lcs} l ON l.a = o.name AND l.b = t.name LEFT JOIN words w ON w.word = coalesce(l.lcs, '')"""


META = _meta_pairs(f"{_affix(LAST_AFFIX)} AS affix, {MENTION} AS mention, {MODERATOR} AS moderator")
META_TOTAL = "affix * 0.3e0 + mention * 0.6e0 + moderator * 0.1e0"

SOURCES = "sources AS (SELECT DISTINCT source AS name FROM documents)"
SOURCE_METADATA = (
    SOURCES,
    "source_mods AS (SELECT DISTINCT subreddit AS name, event_type AS mod FROM event_posts)",
    """source_mentions AS (
        SELECT DISTINCT e.subreddit AS name, d.source AS mention FROM event_posts e JOIN documents d ON d.doc_id = e.link)""",
    _lists("mod_lists", "source_mods", "mod", "mods"),
    _lists("mention_lists", "source_mentions", "mention", "mentions"),
    *_mined("mined", "sources"),
    _tagged("tagged", "sources", "mined"),
    _metadata("metadata", "sources", "tagged", "mod_lists", "mention_lists"),
    "words AS (SELECT name AS word FROM sources)",
    *_lcs("lcs", "sources", "name", 1),
)

# Sources, pages and trades

LISTING = r"""
    SELECT page_id, position, regexp_extract(entry, 'href="/([^"]*)"', 1) AS name
    FROM (SELECT page_id, unnest(entries) AS entry, unnest(range(0, len(entries))) AS position
          FROM (SELECT page_id, regexp_extract_all(
                    split_part(substr(html, strpos(html, '<nav>') + 5), '</nav>', 1), '<a [^>]*>') AS entries
                FROM pages WHERE strpos(html, '<nav>') > 0))
    WHERE regexp_matches(entry, 'href="(/)[a-z]') AND regexp_extract(entry, 'href="/([^"]*)"', 1) <> ''"""
WIKI = r"""wiki AS (
    SELECT regexp_extract(html, '<html lang="([a-z]+)"', 1) AS name,
           regexp_replace(html, 'href="/([^"]*)"', 'r/\1/about ', 'g') AS text FROM pages)"""
RAW_MENTIONS = r"""raw AS (
    SELECT name, unnest(regexp_extract_all(text,
        'r/[^\n][^()\].\s:+\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]*')) AS raw
    FROM wiki)"""
TRADES = """trades AS (
    SELECT 'NATION_' || c_nationkey AS s1, 'NATION_' || s_nationkey AS s2, l_extendedprice AS score,
           row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey)"""

FUSED = f"""
    SELECT p.s1, p.s2, p.text, p.usr AS "user", p.meta, p.text + p.usr + p.meta AS total FROM (
        SELECT g.s1, g.s2, coalesce(g.jaccard, 0) * 0.3e0 + coalesce(a.jaccard, 0) * 0.3e0 AS text,
               coalesce(u.freq / sqrt(CAST(u.n1 AS DOUBLE) * u.n2), 0) * 0.3e0 AS usr,
               coalesce(m.score, 0) * 0.1e0 AS meta
        FROM ({_jaccard('gram')}) g LEFT JOIN ({_jaccard('author')}) a ON a.s1 = g.s1 AND a.s2 = g.s2
        LEFT JOIN user_pairs u ON u.s1 = least(g.s1, g.s2) AND u.s2 = greatest(g.s1, g.s2)
        LEFT JOIN (SELECT s1, s2, {META_TOTAL} AS score FROM meta) m ON m.s1 = g.s2 AND m.s2 = g.s1) p"""


ITEMSETS = f"""
    SELECT CAST(1 AS BIGINT) AS size, item AS items, freq FROM frequent
    UNION ALL SELECT 2, a || '|' || b, freq FROM two
    UNION ALL SELECT 3, a.subreddit || '|' || b.subreddit || '|' || c.subreddit, count(*) FROM basket_edges a
        JOIN basket_edges b ON a.author = b.author AND a.subreddit < b.subreddit
        JOIN basket_edges c ON b.author = c.author AND b.subreddit < c.subreddit
        GROUP BY a.subreddit, b.subreddit, c.subreddit HAVING count(*) >= (SELECT n FROM support)"""
ITEMSET_LEVELS = (
    f"support AS (SELECT greatest(1, ceil(count(*) * {SET_SHARE}e0)) AS n FROM customer)",
    "frequent AS (SELECT subreddit AS item, count(*) AS freq FROM basket_edges GROUP BY 1 HAVING count(*) >= (SELECT n FROM support))",
    """two AS (SELECT x.subreddit AS a, y.subreddit AS b, count(*) AS freq FROM basket_edges x JOIN basket_edges y
        ON x.author = y.author AND x.subreddit < y.subreddit GROUP BY 1, 2 HAVING count(*) >= (SELECT n FROM support))""",
)


def oracle_sql() -> dict[str, str]:
    affix_lcs = ("words AS (SELECT DISTINCT unnest(string_split(name, ' ')) AS word FROM part_names)", *_lcs("lcs", "part_names", "name", 1))
    baskets = (PURCHASES, BASKET_EDGES)
    csv = "SELECT * FROM metadata"
    cosine = "SELECT s1, s2, round(freq / sqrt(CAST(n1 AS DOUBLE) * n2), 6) AS score FROM user_pairs"
    components = 'SELECT subreddit, "index" FROM parts'
    rounded = "SELECT s1, s2, n1, n2, common, round(jaccard, 6) AS jaccard FROM"
    turn_tokens = f"turn_tokens AS (SELECT {_tokens('text')} AS tokens FROM conversations)"
    turns = f"turns AS (SELECT unnest({_grams('tokens')}) AS ngram FROM turn_tokens)"
    posts = (EVENT_POSTS, POSTS)
    gram_counts = _pair_counts("gram", "edges", "ngram")
    author_counts = _pair_counts("author", "posts", "author")
    fused = _with(
        f"""SELECT s1, s2, round(text, 6) AS text, round("user", 6) AS "user", round(meta, 6) AS meta, round(total, 6) AS total
        FROM ({FUSED})""",
        SOURCE_ORDS,
        *TEXT,
        *posts,
        *gram_counts,
        *author_counts,
        *_pair_counts("basket", "(SELECT * FROM posts WHERE author <> '[deleted]')", "author"),
        _user_pairs("user_pairs"),
        *SOURCE_METADATA,
        f"meta AS ({META})",
    )
    return {
        "json_roundtrip": _with("SELECT subreddit, title, author FROM posts", *posts),
        "parquet_roundtrip": _with(
            f"SELECT subreddit, title, author FROM posts WHERE subreddit IN ({_quoted(TEN_SOURCES)})", *posts
        ),
        "components_roundtrip": _with(components, *TEXT, NGRAM_IDS, COMPONENTS),
        "basket_roundtrip": _with(
            f"SELECT communities, count(*) AS authors FROM ({_baskets('allowed_edges')}) GROUP BY communities", *baskets, ALLOWED_EDGES
        ),
        "meta_csv_roundtrip": _with(csv, *NATION_METADATA),
        "meta_first_rows": _with(f"SELECT m.* FROM metadata m JOIN nations n ON n.name = m.name WHERE n.key < {FIRST_ROWS}", *NATION_METADATA),
        "scores_roundtrip": _with(cosine, *BASKET_PAIRS),
        "filter_inlist": f"SELECT doc_id, source, n_chars FROM documents WHERE source IN ({_quoted(TEN_SOURCES)})",
        "filter_inset": f"SELECT doc_id, source, n_chars FROM documents WHERE source IN ({_quoted(JOINED_SOURCES.split(','))})",
        "filter_not_equal": "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority <> '5-LOW'",
        "allowlist_semi": """SELECT doc_id, source, n_chars FROM documents WHERE source IN (
            SELECT source FROM documents GROUP BY source HAVING sum(n_chars) > 2400 * count(*))""",
        "page_listing_extract": LISTING,
        "page_listing_first_pages": f"{LISTING} AND page_id < {FIRST_PAGES}",
        "tokenize": _with("SELECT doc_id, subreddit, array_to_string(tokens, ' ') AS tokens FROM doc_tokens", DOC_TOKENS),
        "tokenize_keep_last_char": f"""SELECT conv_id, turn, array_to_string({_tokens('text', True)}, ' ') AS tokens
            FROM conversations""",
        "ngrams_per_doc": _with(
            "SELECT doc_id, len(ngrams) AS n, array_to_string(ngrams, '|') AS ngrams FROM doc_grams", DOC_TOKENS, DOC_GRAMS
        ),
        "ngram_edges": _with("SELECT subreddit, ngram FROM edges", *TEXT),
        "ngram_vocab": _with("SELECT DISTINCT ngram FROM edges", *TEXT),
        "ngram_vocab_size": _with("SELECT count(DISTINCT ngram) AS size FROM edges", *TEXT),
        "ngram_index": _with('SELECT ngram, "index" FROM ids', *TEXT, NGRAM_IDS),
        "ngram_components": _with(components, *TEXT, NGRAM_IDS, COMPONENTS),
        "user_vocab": _with('SELECT DISTINCT author AS "user" FROM purchases', PURCHASES),
        "user_index": _with(
            """SELECT author AS "user", row_number() OVER (ORDER BY author) - 1 AS "index"
            FROM (SELECT DISTINCT author FROM purchases)""",
            PURCHASES,
        ),
        "user_components": _with(
            """SELECT p.subreddit, i."index" FROM purchases p JOIN (
                SELECT author, row_number() OVER (ORDER BY author) - 1 AS "index"
                FROM (SELECT DISTINCT author FROM purchases)) i ON p.author = i.author""",
            PURCHASES,
        ),
        "community_components": _with(
            f"""SELECT "index" FROM parts WHERE subreddit = '{ONE_SOURCE}'""", *TEXT, NGRAM_IDS, COMPONENTS
        ),
        "community_vectors": _with(
            f"""SELECT subreddit, "index" // {VECTOR_BLOCK} AS block, (SELECT count(*) FROM ids) AS size,
                string_agg(CAST("index" AS VARCHAR), ',' ORDER BY "index") AS indices FROM parts GROUP BY 1, 2""",
            *TEXT,
            NGRAM_IDS,
            COMPONENTS,
        ),
        "vector_norms": _with(
            f"""SELECT subreddit, "index" // {VECTOR_BLOCK} AS block, min(length) AS length, count(*) AS entries,
                round(1 / sqrt(count(*)), 6) AS scaled
            FROM (SELECT e.subreddit, i."index", least({VECTOR_BLOCK}, (SELECT count(*) FROM users) - i."index" // {VECTOR_BLOCK} * {VECTOR_BLOCK}) AS length
                FROM (SELECT DISTINCT subreddit, author FROM purchases WHERE author IS NOT NULL) e JOIN users i ON e.author = i.author)
            GROUP BY 1, 2""",
            PURCHASES,
            """users AS (SELECT author, row_number() OVER (ORDER BY author) - 1 AS "index" FROM (
                SELECT DISTINCT author FROM purchases WHERE author IS NOT NULL))""",
        ),
        "pair_spine": _with("SELECT x.o AS i, y.o AS j, x.s AS s1, y.s AS s2 FROM ords x JOIN ords y ON x.o < y.o", SOURCE_ORDS),
        "directed_pairs": _with(
            "SELECT x.o AS i, y.o AS j, x.s AS s1, y.s AS s2 FROM ords x JOIN ords y ON x.o <> y.o", SOURCE_ORDS
        ),
        "set_union": _with("SELECT ngram FROM edges UNION SELECT ngram FROM turns", *TEXT, turn_tokens, turns),
        "set_intersect": _with("SELECT ngram FROM edges INTERSECT SELECT ngram FROM turns", *TEXT, turn_tokens, turns),
        "ngram_jaccard": _with(f"{rounded} ({_jaccard('gram')})", *TEXT, *gram_counts, SOURCE_ORDS),
        "user_jaccard": _with(
            f"{rounded} ({_jaccard('author')})", PURCHASES, *_pair_counts("author", "purchases", "author"), BRAND_ORDS
        ),
        "user_jaccard_sharing": _with(
            """SELECT c.s1, c.s2, x.n AS n1, y.n AS n2, c.common, round(c.common / CAST(x.n + y.n - c.common AS DOUBLE), 6) AS jaccard
            FROM author_common c JOIN author_sizes x ON x.s = c.s1 JOIN author_sizes y ON y.s = c.s2""",
            SUPPLIES,
            *_pair_counts("author", "supplies", "author"),
        ),
        "component_jaccard": _with(f"{rounded} ({_jaccard('gram')})", *TEXT, *gram_counts, SOURCE_ORDS),
        "text_scores": _with(
            f"""SELECT g.s1, g.s2, round(g.jaccard, 6) AS ngram, round(a.jaccard, 6) AS "user"
            FROM ({_jaccard('gram')}) g JOIN ({_jaccard('author')}) a ON a.s1 = g.s1 AND a.s2 = g.s2""",
            SOURCE_ORDS,
            *TEXT,
            *posts,
            *gram_counts,
            *author_counts,
        ),
        "author_baskets": _with(_baskets("allowed_edges"), *baskets, ALLOWED_EDGES),
        "frequent_items": _with("SELECT item, freq FROM items", *baskets, _items("basket_edges")),
        "basket_prune": _with(
            _baskets("(SELECT * FROM allowed_edges WHERE subreddit IN (SELECT item FROM items))"), *baskets, ALLOWED_EDGES, _items("allowed_edges")
        ),
        "pair_support": _with("SELECT s1, s2, freq FROM user_pairs", *BASKET_PAIRS),
        "pair_support_threshold": _with(
            f"SELECT s1, s2, freq FROM user_pairs WHERE freq >= {PAIR_SUPPORT} AND n1 >= {PAIR_SUPPORT} AND n2 >= {PAIR_SUPPORT}", *BASKET_PAIRS
        ),
        "frequent_itemsets": _with(ITEMSETS, *baskets, *ITEMSET_LEVELS),
        "assoc_rules": _with(
            """SELECT s1 AS antecedent, s2 AS consequent, round(freq / CAST(n1 AS DOUBLE), 6) AS confidence, freq FROM user_pairs
            UNION ALL SELECT s2, s1, round(freq / CAST(n2 AS DOUBLE), 6), freq FROM user_pairs""",
            *BASKET_PAIRS,
        ),
        "user_cosine": _with(cosine, *BASKET_PAIRS),
        "name_lcs": _with(
            """SELECT x.name AS s1, y.name AS s2, coalesce(l.lcs, '') AS lcs FROM part_names x
            JOIN part_names y ON x.name <> y.name LEFT JOIN lcs l ON l.a = x.name AND l.b = y.name""",
            PART_NAMES,
            *_lcs("lcs", "part_names", "name", 1),
        ),
        "affix_mine": _with("SELECT affix, freq FROM mined", TYPED_NAMES, *_mined("mined", "typed_names")),
        "affix_tag": _with("SELECT name, affixes FROM tagged", *PART_AFFIXES),
        "mention_extract": _with(
            """SELECT DISTINCT name, regexp_extract(substr(raw, 3), '^(?s:(.[^/]*))', 1) AS mention FROM raw
            WHERE NOT contains(raw, name) AND NOT contains(raw, lower(name))""",
            WIKI,
            RAW_MENTIONS,
        ),
        "mention_list": _with("SELECT name, mentions FROM mention_lists", *NATION_LISTS),
        "mod_list": _with("SELECT name, mods FROM mod_lists", *NATION_LISTS),
        "meta_dataset": _with(csv, *NATION_METADATA),
        "affix_similarity": _with(_meta_pairs(f"{_affix(LAST_AFFIX)} AS score", "tagged"), *PART_AFFIXES, *affix_lcs),
        "affix_similarity_any": _with(_meta_pairs(f"{_affix(ANY_AFFIX)} AS score", "tagged"), *PART_AFFIXES, *affix_lcs),
        "mod_similarity": _with(
            f"""SELECT t.name AS s1, o.name AS s2, round({MODERATOR}, 6) AS score, round({MODERATOR_OVERLAP}, 6) AS overlap_score
            FROM metadata t JOIN metadata o ON t.name <> o.name""",
            *NATION_METADATA,
        ),
        "wiki_similarity": _with(
            f"""SELECT t.name AS s1, o.name AS s2, {MENTION} AS score, {CO_MENTION} AS co_mention_score
            FROM metadata t JOIN metadata o ON t.name <> o.name""",
            *NATION_METADATA,
        ),
        "meta_score": _with(
            f"""SELECT s1, s2, affix, mention, round(moderator, 6) AS moderator, round({META_TOTAL}, 6) AS score FROM meta""",
            *NATION_METADATA,
            NATION_WORDS,
            *_lcs("lcs", "nations", "name", 1),
            f"meta AS ({META})",
        ),
        "pair_dedup": _with(
            """SELECT a, b, arg_min(score, ord) AS "first", arg_max(score, ord) AS "last"
            FROM (SELECT least(s1, s2) AS a, greatest(s1, s2) AS b, score, ord FROM trades) GROUP BY a, b""",
            TRADES,
        ),
        "fuse_scores": fused,
        "fuse_score_files": fused,
    }
