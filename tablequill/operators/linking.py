"""Links between the words of a question and the elements of its schema.

Inputs: ``questions(example_id, schema_id, question)`` and a ``Catalog``.
Every link frame has the columns of LINK plus the ordinals ``stage, o1, o2, o3``
that give its place in the list of links of its kind.

The schema elements travel as bounded chunks (arrays of at most CHUNK_TABLES *
CHUNK_COLUMNS elements). A question meets the chunks of its own schema by an
equi-join and keeps the matching elements inside the row, so pairs that do not
match never become rows.

A schema with more than WIDE_SCHEMA elements is not read whole by every question:
its elements are found by the beginnings of their names, which must occur in the
question, and only those are matched (``_meet_wide``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.ordered import joined
from tablequill.functions.scale import attach, salted_join
from tablequill.functions.text import find, one_of, words
from tablequill.operators.similarity import similar_terms
from tablequill.session import settle

LINK = [
    "example_id", "question_text", "schema_element", "link_type", "confidence",
    "span_start", "span_end",
]
ORDER = ["stage", "o1", "o2", "o3"]
TABLE, COLUMN, VALUE = "table", "column", "value"
CHUNK_TABLES = 32
CHUNK_COLUMNS = 256
# Elements from which a schema is looked up by grams, and characters of a gram.
WIDE_SCHEMA = 2048
GRAM = 4


def _link(text: Column, start: Column, confidence: Column | float, *order: Column | int) -> Column:
    """Struct of one link; ``order`` is (o1, o2, o3)."""
    o = [c if isinstance(c, Column) else F.lit(c) for c in order]
    conf = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return F.struct(
        text.alias("question_text"),
        conf.alias("confidence"),
        start.alias("span_start"),
        (start + F.length(text)).alias("span_end"),
        *[c.cast("int").alias(f"o{i}") for i, c in enumerate(o, 1)],
    )


def _rows(df: DataFrame, element: Column, link_type: str, stage: int) -> DataFrame:
    """Rows with a column ``link`` as links."""
    return df.select(
        "example_id",
        F.col("link.question_text").alias("question_text"),
        element.alias("schema_element"),
        F.lit(link_type).alias("link_type"),
        F.col("link.confidence").alias("confidence"),
        F.col("link.span_start").alias("span_start"),
        F.col("link.span_end").alias("span_end"),
        F.lit(stage).alias("stage"),
        F.col("link.o1").alias("o1"),
        F.col("link.o2").alias("o2"),
        F.col("link.o3").alias("o3"),
    )


def table_elements(tables: DataFrame) -> DataFrame:
    """(schema_id, chunk, e): the tables as elements with the chunk they belong to."""
    return tables.select(
        "schema_id",
        F.floor(F.col("table_ord") / CHUNK_TABLES).alias("chunk"),
        F.struct("table_name", F.lower("table_name").alias("low"), "table_ord").alias("e"),
    )


def column_elements(columns: DataFrame) -> DataFrame:
    """(schema_id, chunk, part, e): the columns as elements with the chunk they belong to."""
    low = F.lower("col_name")
    return columns.select(
        "schema_id",
        F.floor(F.col("table_ord") / CHUNK_TABLES).alias("chunk"),
        F.floor(F.col("col_ord") / CHUNK_COLUMNS).alias("part"),
        F.struct(
            F.concat_ws(".", "table_name", "col_name").alias("element"),
            "col_name",
            low.alias("low"),
            name_words(low).alias("words"),
            "dtype",
            "table_ord",
            "col_ord",
        ).alias("e"),
    )


def table_chunks(tables: DataFrame) -> DataFrame:
    return table_elements(tables).groupBy("schema_id", "chunk").agg(F.collect_list("e").alias("elements"))


def column_chunks(columns: DataFrame) -> DataFrame:
    return (
        column_elements(columns).groupBy("schema_id", "chunk", "part")
        .agg(F.collect_list("e").alias("elements"))
    )


def name_words(low: Column) -> Column:
    return words(F.translate(low, "_", " "))


def _meet(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Questions with the chunks of their schema; see ``scale.attach`` for popular schemas."""
    asked = questions.withColumn("low_q", F.lower("question"))
    return attach(asked, chunks, ["schema_id"], ["example_id"])


def _substrings(text: Column, length: int) -> Column:
    """All substrings of one length."""
    starts = F.sequence(F.lit(1), F.length(text) - (length - 1))
    every = F.transform(starts, lambda i: F.substring(text, i, F.lit(length)))
    return F.when(F.length(text) >= length, every).otherwise(F.array().cast("array<string>"))


def _begin(text: Column) -> Column:
    return F.substring(text, 1, GRAM)


def _occurs(kind: str, texts: Column) -> Column:
    """Keys of texts, or of their grams, apart by ``kind``; a NULL array has none."""
    keys = F.transform(texts, lambda t: F.concat(F.lit(kind), t))
    return F.coalesce(keys, F.array().cast("array<string>"))


def _spoken(low_q: Column) -> Column:
    """Keys that the beginning of any text inside the question has; the empty text is in all."""
    grams = F.flatten(F.array(*[_substrings(low_q, n) for n in range(1, GRAM + 1)]))
    return F.concat(F.array(F.lit("=")), _occurs("=", grams))


def _table_keys() -> Column:
    """The beginning of the name, to be in the question; its grams, for words of the question."""
    low = F.col("e.low")
    return F.concat(_occurs("=", F.array(_begin(low))), _occurs("~", _substrings(low, GRAM)))


def _table_probes() -> Column:
    long_words = F.filter(words(F.col("low_q")), lambda w: F.length(w) >= GRAM)
    return F.concat(_spoken(F.col("low_q")), _occurs("~", F.transform(long_words, _begin)))


def _column_keys() -> Column:
    """The beginnings of the name and of its words, to be in the question."""
    long_words = F.filter("e.words", lambda w: F.length(w) > 2)
    return F.concat(
        _occurs("=", F.array(_begin(F.col("e.low")))), _occurs("=", F.transform(long_words, _begin))
    )


def _column_probes() -> Column:
    return _spoken(F.col("low_q"))


def _meet_wide(questions: DataFrame, elements: DataFrame, keys: Column, probes: Column) -> DataFrame:
    """Questions with those elements of their schema that have a key among the probes.

    Elements without one cannot match. The candidates are found once per
    different question of a schema and stay in chunks of bounded size.
    """
    asked = questions.withColumn("low_q", F.lower("question")).withColumn("_q", F.md5("low_q"))
    places = [c for c in ("chunk", "part") if c in elements.columns]
    index = elements.withColumn("_key", F.explode(F.array_distinct(keys))).where(F.col("_key").isNotNull())
    probing = asked.select("schema_id", "_q", "low_q").dropDuplicates(["schema_id", "_q"]).select(
        "schema_id", "_q", F.explode(F.array_distinct(probes)).alias("_key")
    )
    found = (
        attach(probing, index, ["schema_id", "_key"], ["_q"])
        .groupBy("schema_id", "_q", *places)
        .agg(F.collect_set("e").alias("elements"))
    )
    return salted_join(asked, found, ["schema_id", "_q"], ["example_id"]).drop("_q", *places)


def _candidates(
    questions: DataFrame, elements: DataFrame, chunks: DataFrame, keys: Column, probes: Column,
    wide_schema: int | None,
) -> DataFrame:
    """Questions with all elements of a narrow schema, or with the candidates of a wide one."""
    limit = WIDE_SCHEMA if wide_schema is None else wide_schema
    counts = elements.groupBy("schema_id").agg(F.count("*").alias("_n"))
    wide = counts.where(F.col("_n") > limit).select("schema_id")
    if wide.isEmpty():
        return _meet(questions, chunks)
    wide = settle(wide, "wide")
    marked = attach(
        questions, wide.withColumn("_wide", F.lit(True)), ["schema_id"], ["example_id"], "left"
    )
    kept = [*questions.columns, "low_q", "elements"]
    narrow = _meet(
        marked.where("_wide IS NULL").drop("_wide"), chunks.join(wide, "schema_id", "left_anti")
    )
    many = _meet_wide(
        marked.where("_wide").drop("_wide"), elements.join(wide, "schema_id", "left_semi"), keys, probes
    )
    return narrow.select(*kept).unionByName(many.select(*kept))


# --- string matches -------------------------------------------------------------------


def _original(low_name: Column, name: Column) -> Column:
    """Text of the question under the first occurrence of a name."""
    return F.substring(F.col("question"), F.position(low_name, F.col("low_q")), F.length(name))


def table_links(
    questions: DataFrame, tables: DataFrame, wide_schema: int | None = None
) -> DataFrame:
    """Exact: the name occurs in the question. Partial, only if not exact: a word
    of more than three letters occurs in the name. Schemas of more than ``wide_schema``
    tables (default WIDE_SCHEMA) are looked up by grams; the links are the same."""
    met = _candidates(
        questions, table_elements(tables), table_chunks(tables), _table_keys(), _table_probes(),
        wide_schema,
    ).withColumn(
        "long_words",
        F.filter(
            F.transform(words(F.col("low_q")), lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
            lambda s: F.length(s["w"]) > 3,
        ),
    )
    low_q = F.col("low_q")

    def exact(e: Column) -> Column:
        text = _original(e["low"], e["table_name"])
        return F.array(
            _link(text, find(low_q, e["low"]), K.EXACT_CONFIDENCE, e["table_ord"], 0, 0)
        )

    def partial(e: Column) -> Column:
        inside = F.filter("long_words", lambda s: e["low"].contains(s["w"]))
        return F.transform(
            inside,
            lambda s: _link(
                s["w"], find(low_q, s["w"]), K.TABLE_PARTIAL_CONFIDENCE, e["table_ord"], s["i"], 0
            ),
        )

    return _matches(met, exact, partial, "table_name", TABLE)


def column_links(
    questions: DataFrame, columns: DataFrame, wide_schema: int | None = None
) -> DataFrame:
    """Exact: the name occurs in the question. Word, only if not exact: a part of
    the name with more than two letters occurs in the question. ``wide_schema`` as
    for tables, counted in columns."""
    met = _candidates(
        questions, column_elements(columns), column_chunks(columns), _column_keys(), _column_probes(),
        wide_schema,
    )
    low_q = F.col("low_q")

    def exact(e: Column) -> Column:
        text = _original(e["low"], e["col_name"])
        return F.array(
            _link(text, find(low_q, e["low"]), K.EXACT_CONFIDENCE, e["table_ord"], e["col_ord"], 0)
        )

    def by_word(e: Column) -> Column:
        numbered = F.transform(e["words"], lambda w, i: F.struct(w.alias("w"), i.alias("i")))
        inside = F.filter(numbered, lambda s: (F.length(s["w"]) > 2) & low_q.contains(s["w"]))
        return F.transform(
            inside,
            lambda s: _link(
                s["w"], find(low_q, s["w"]), K.COLUMN_WORD_CONFIDENCE,
                e["table_ord"], e["col_ord"], s["i"],
            ),
        )

    return _matches(met, exact, by_word, "element", COLUMN)


def _matches(met: DataFrame, exact, otherwise, element: str, link_type: str) -> DataFrame:
    low_q = F.col("low_q")
    found = F.transform(
        "elements",
        lambda e: F.struct(
            e[element].alias("element"),
            F.when(low_q.contains(e["low"]), exact(e)).otherwise(otherwise(e)).alias("links"),
        ),
    )
    hits = met.select("example_id", F.explode(found).alias("hit")).select(
        "example_id", F.col("hit.element").alias("element"), F.explode("hit.links").alias("link")
    )
    return _rows(hits, F.col("element"), link_type, 0)


# --- vector matches ---------------------------------------------------------------------


def _content_words(questions: DataFrame, longer_than: int) -> DataFrame:
    """(example_id, schema_id, word, word_ord, span_start) of words worth a vector."""
    low_q = F.lower("question")
    distinct = F.filter(
        F.array_distinct(words(low_q)),
        lambda w: (F.length(w) > longer_than) & ~one_of(w, K.STOP_WORDS),
    )
    return (
        questions.select("example_id", "schema_id", low_q.alias("low_q"), distinct.alias("ws"))
        .select("example_id", "schema_id", "low_q", F.posexplode("ws").alias("word_ord", "word"))
        .select(
            "example_id", "schema_id", "word", "word_ord",
            find(F.col("low_q"), F.col("word")).alias("span_start"),
        )
    )


def _vector_hits(
    asked: DataFrame, targets: DataFrame, term_vectors: DataFrame, threshold: float
) -> DataFrame:
    """Words with the terms of their schema whose dot product reaches the threshold.

    Similarities are rounded to six digits: equal ones stay equal, in whatever
    order their sums were added up. A term that most schemas have is spread.
    """
    # Read for the distinct words and again for the links.
    asked = settle(asked, "words")
    vectors = term_vectors.select("term", "vector")
    said = asked.select("schema_id", F.col("word").alias("term")).distinct()
    left = salted_join(said, vectors, ["term"], ["schema_id"])
    right = salted_join(targets.select("schema_id", "term").distinct(), vectors, ["term"], ["schema_id"])
    similar = similar_terms(left, right, ["schema_id"], threshold, cosine=False)
    pairs = similar.select(
        "schema_id", F.col("left_term").alias("word"), F.col("right_term").alias("term"),
        F.round("similarity", 6).alias("similarity"),
    ).join(targets, ["schema_id", "term"])
    return attach(asked, pairs, ["schema_id", "word"], ["example_id"])


def table_vector_links(
    questions: DataFrame,
    tables: DataFrame,
    string_links: DataFrame,
    term_vectors: DataFrame,
    threshold: float = K.VECTOR_THRESHOLD,
) -> DataFrame:
    """Only for questions without any string link to a table."""
    open_ = questions.join(string_links.select("example_id"), "example_id", "left_anti")
    targets = tables.select("schema_id", F.lower("table_name").alias("term"), "table_name", "table_ord")
    hits = _vector_hits(_content_words(open_, 3), targets, term_vectors, threshold)
    link = _link(
        F.col("word"), F.col("span_start"), F.col("similarity"),
        F.col("word_ord"), F.col("table_ord"), 0,
    )
    return _rows(hits.withColumn("link", link), F.col("table_name"), TABLE, 1)


def column_variants(columns: DataFrame) -> DataFrame:
    """Texts that stand for a column: its name, then its parts of more than two letters."""
    low = F.lower("col_name")
    parts = F.filter(name_words(low), lambda w: F.length(w) > 2)
    return columns.select(
        "schema_id",
        F.concat_ws(".", "table_name", "col_name").alias("element"),
        "table_ord",
        "col_ord",
        F.posexplode(F.concat(F.array(low), parts)).alias("variant_ord", "term"),
    )


def column_vector_links(
    questions: DataFrame,
    columns: DataFrame,
    string_links: DataFrame,
    term_vectors: DataFrame,
    threshold: float = K.VECTOR_THRESHOLD,
    enough: int = 3,
) -> DataFrame:
    """Only for questions with fewer than ``enough`` string links to columns.

    One link per column and word; the first variant that reaches the threshold
    gives the confidence. A string link with the same column and text excludes it.
    """
    counts = string_links.groupBy("example_id").agg(F.count("*").alias("n"))
    served = counts.where(F.col("n") >= enough)
    open_ = questions.join(served, "example_id", "left_anti")
    hits = _vector_hits(_content_words(open_, 2), column_variants(columns), term_vectors, threshold)
    best = (
        hits.groupBy(
            "example_id", "element", "word", "word_ord", "span_start", "table_ord", "col_ord"
        )
        .agg(F.min_by("similarity", "variant_ord").alias("similarity"))
    )
    linked = string_links.select(
        "example_id", F.col("schema_element").alias("element"), F.col("question_text").alias("word")
    )
    fresh = best.join(linked, ["example_id", "element", "word"], "left_anti")
    link = _link(
        F.col("word"), F.col("span_start"), F.col("similarity"),
        F.col("word_ord"), F.col("table_ord"), F.col("col_ord"),
    )
    return _rows(fresh.withColumn("link", link), F.col("element"), COLUMN, 1)


# --- values --------------------------------------------------------------------------------


def value_candidates(questions: DataFrame) -> DataFrame:
    """Quoted strings, then capitalised words; pure digits drop out."""
    quoted = F.transform(
        F.regexp_extract_all("question", F.lit("\"([^\"]+)\"|'([^']+)'"), F.lit(0)),
        lambda q: F.substring(q, F.lit(2), F.length(q) - 2),
    )
    runs = F.regexp_extract_all("question", F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    capitalised = F.filter(
        runs, lambda w: w.rlike("^[A-Z][a-z]+$") & ~one_of(F.lower(w), K.STOP_WORDS)
    )
    return questions.select(
        "example_id",
        "schema_id",
        "question",
        F.posexplode(F.concat(quoted, capitalised)).alias("value_ord", "value"),
    ).where(~F.col("value").rlike(r"^\p{Nd}+$"))


def value_links(
    questions: DataFrame, columns: DataFrame, threshold: float = K.VALUE_THRESHOLD
) -> DataFrame:
    """Values with the columns whose name or type fits them."""
    candidates = value_candidates(questions)
    if threshold > K.TEXT_VALUE_CONFIDENCE:
        # Only the name rules can reach the threshold: other columns never travel.
        low = F.lower("col_name")
        columns = columns.where(low.contains("name") | low.contains("date"))
    met = _meet(candidates, column_chunks(columns))
    value, low_q = F.col("value"), F.col("low_q")
    upper_first = value.rlike(r"^\p{Lu}")
    has_mark = value.contains("/") | value.contains("-")

    def confidence(e: Column) -> Column:
        return (
            F.when(e["low"].contains("name") & upper_first, F.lit(K.NAME_VALUE_CONFIDENCE))
            .when(e["low"].contains("date") & has_mark, F.lit(K.DATE_VALUE_CONFIDENCE))
            .when(e["dtype"] == "text", F.lit(K.TEXT_VALUE_CONFIDENCE))
            .otherwise(F.lit(0.0))
        )

    scored = F.transform("elements", lambda e: F.struct(e.alias("e"), confidence(e).alias("conf")))
    fits = F.filter(scored, lambda s: s["conf"] >= threshold)
    at = find(low_q, F.lower("value"))
    start = F.when(at >= 0, at).otherwise(F.greatest(F.lit(0), find(F.col("question"), value)))
    hits = met.select(
        "example_id", "value", "value_ord", start.alias("start"), F.explode(fits).alias("fit")
    ).withColumn(
        "link",
        _link(
            F.col("value"), F.col("start"), F.col("fit.conf"),
            F.col("value_ord"), F.col("fit.e.table_ord"), F.col("fit.e.col_ord"),
        ),
    )
    return _rows(hits, F.col("fit.e.element"), VALUE, 0)


# --- combination ------------------------------------------------------------------------------


def _type_rank() -> Column:
    link_type = F.col("link_type")
    return F.when(link_type == TABLE, 0).when(link_type == COLUMN, 1).otherwise(2)


def best_links(links: DataFrame, min_confidence: float = K.MIN_CONFIDENCE) -> DataFrame:
    """The best link of every span, the earliest on a tie.

    ``first_seen`` orders links of equal confidence: it is the place of the
    first link of the span. The choice is an aggregate with map-side combine.
    """
    place = F.struct(_type_rank().alias("type_rank"), *ORDER)
    better = F.struct((-F.col("confidence")).alias("c"), place.alias("place"))
    kept = ["question_text", "schema_element", "link_type", "confidence"]
    return (
        links.groupBy("example_id", "span_start", "span_end")
        .agg(F.min_by(F.struct(*kept), better).alias("best"), F.min(place).alias("first_seen"))
        .where(F.col("best.confidence") >= min_confidence)
        .select("example_id", "best.*", "span_start", "span_end", "first_seen")
    )


def schema_links(
    questions: DataFrame,
    tables: DataFrame,
    columns: DataFrame,
    term_vectors: DataFrame | None = None,
    include_values: bool = False,
    vector_threshold: float = K.VECTOR_THRESHOLD,
    min_confidence: float = K.MIN_CONFIDENCE,
) -> DataFrame:
    """All links of the questions, reduced to the best one per span."""
    to_tables = table_links(questions, tables)
    to_columns = column_links(questions, columns)
    if term_vectors is not None:
        # Read again by the gates of the vector stage; narrow rows, written once.
        to_tables, to_columns = settle(to_tables, "links"), settle(to_columns, "links")
    links = to_tables.unionByName(to_columns)
    if term_vectors is not None:
        links = links.unionByName(
            table_vector_links(questions, tables, to_tables, term_vectors, vector_threshold)
        ).unionByName(
            column_vector_links(questions, columns, to_columns, term_vectors, vector_threshold)
        )
    if include_values:
        links = links.unionByName(value_links(questions, columns))
    return best_links(links, min_confidence)


def with_links_text(
    examples: DataFrame, links: DataFrame, min_confidence: float = K.MIN_CONFIDENCE
) -> DataFrame:
    """``examples`` with a column ``links_text``, empty for examples without links."""
    value_mark = F.when(F.col("link_type") == VALUE, F.lit("value, ")).otherwise(F.lit(""))
    target = F.when(F.col("link_type") == TABLE, F.lit(TABLE)).otherwise(F.lit(COLUMN))
    line = F.format_string(
        'Question word "%s" → %s: %s (%sconfidence: %.2f)',
        "question_text", target, "schema_element", value_mark, "confidence",
    )
    order = [_type_rank(), -F.col("confidence"), F.col("first_seen")]
    texts = (
        links.where(F.col("confidence") >= min_confidence)
        .groupBy("example_id")
        .agg(joined(line, order, "\n").alias("body"))
    )
    text = F.coalesce(F.concat(F.lit("[SCHEMA LINKS]\n"), "body"), F.lit(""))
    return (
        examples.join(texts, "example_id", "left").withColumn("links_text", text).drop("body")
    )
