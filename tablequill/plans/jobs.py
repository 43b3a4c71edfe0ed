"""Whole jobs: preparation of corpora, training records, reports over predictions and candidates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablequill import constants as K
from tablequill.functions.ordered import percent
from tablequill.operators import candidates as C
from tablequill.operators import corpora, evaluate, linking, logical_form, prompts, text_store
from tablequill.operators.catalog import Catalog, catalog_from_single_tables
from tablequill.session import DROP_SHUFFLES, job_folder, session_conf, settle
from tablequill.sources import writers


def training_records(
    examples: DataFrame,
    prompt_style: str = "detailed",
    styles: DataFrame | None = None,
    link_catalog: Catalog | None = None,
    term_vectors: DataFrame | None = None,
) -> DataFrame:
    """``examples`` of ``operators.corpora`` with the columns ``input`` and ``output``.

    With ``link_catalog`` the words of each question are linked to its schema
    and the links become part of the prompt.
    """
    ready = examples
    if link_catalog is not None:
        # read for tables, for columns and by the vector stage
        questions = settle(examples.select("example_id", "schema_id", "question"), "questions")
        links = linking.schema_links(
            questions, link_catalog.tables, link_catalog.columns, term_vectors
        )
        ready = linking.with_links_text(examples, links)
    if prompt_style == "simple":
        return prompts.simple_record(ready)
    styles = prompts.style_table(examples.sparkSession) if styles is None else styles
    prompt = prompts.user_prompt(
        prompts.instruction_of(styles, prompt_style),
        F.col("schema"),
        F.col("question"),
        F.col("links_text") if link_catalog is not None else None,
    )
    return prompts.training_record(ready, prompt)


@dataclass(frozen=True)
class Options:
    """What a preparation does."""

    style: str = "structured"
    # Only these complexities (corpora that have none keep all rows).
    complexities: list[str] | None = None
    # First rows of every dataset and split.
    first_n: int | None = None
    # Logical forms: a sample with as many queries of every pattern.
    quota: int | None = None
    # Datasets whose rows drop out if their DDL has no table; None means all.
    drop_empty: list[str] | None = None
    # Show similar columns in the schema texts; needs ``term_vectors``.
    semantic_links: bool = False
    vector_threshold: float = K.VECTOR_THRESHOLD
    # Link the words of the questions to their schemas and build prompts.
    schema_links: bool = False
    prompt_style: str = "detailed"
    formats: tuple[str, ...] = tuple(writers.FORMATS)
    seed: int = 42
    # Folder with the schema texts of earlier runs (``operators.text_store``). Without any
    # kind of links, only DDL texts that it lacks are parsed.
    text_store: str | None = None


def _selected(corpus: DataFrame, options: Options) -> DataFrame:
    if options.complexities and "complexity" in corpus.columns:
        corpus = corpora.of_complexity(corpus, options.complexities)
    if "split" not in corpus.columns:
        corpus = corpora.positional_split(corpus, ["dataset"], "example_id")
    if options.first_n:
        corpus = corpora.first_examples(corpus, ["dataset", "split"], "example_id", options.first_n)
    return corpus


def prepare(
    folder: str,
    options: Options = Options(),
    catalog_corpus: DataFrame | None = None,
    schemas: Catalog | None = None,
    ddl_corpus: DataFrame | None = None,
    logical: DataFrame | None = None,
    single_tables: DataFrame | None = None,
    term_vectors: DataFrame | None = None,
) -> DataFrame:
    """Everything from corpora to files below ``folder`` (see ``writers.write_corpus``).

    ``catalog_corpus`` goes with ``schemas``, ``logical`` (with a split) with
    ``single_tables``. A corpus without a split is cut by position;
    ``example_id`` is its position, see ``readers.with_line_ordinal``. Returns
    the summary of what was written. Tables stored on the way are removed.
    """
    spark = next(c for c in (catalog_corpus, ddl_corpus, logical) if c is not None).sparkSession

    def similar(catalog: Catalog) -> DataFrame | None:
        if not options.semantic_links:
            return None
        return corpora.semantic_links(catalog, term_vectors, options.vector_threshold)

    def records(examples: DataFrame, catalog: Catalog | None) -> DataFrame:
        if not options.schema_links:
            return examples
        return training_records(
            examples, options.prompt_style, link_catalog=catalog, term_vectors=term_vectors
        )

    with job_folder(spark, "prepare"), session_conf(spark, DROP_SHUFFLES, "true"):
        parts = []
        if logical is not None:
            if options.quota:
                samples = [
                    logical_form.balanced_sample(logical.where(F.col("split") == split), n, options.seed)
                    for split, n in (("train", options.quota), ("dev", logical_form.dev_quota(options.quota)))
                ]
                logical = samples[0].unionByName(samples[1])
            examples = corpora.from_logical_form(
                _selected(logical, options), single_tables, options.style
            )
            parts.append(records(examples, catalog_from_single_tables(single_tables)))
        if catalog_corpus is not None:
            examples = corpora.from_catalog(
                _selected(catalog_corpus, options), schemas, options.style, similar(schemas)
            )
            parts.append(records(examples, schemas))
        if ddl_corpus is not None:
            # read for its DDL texts and for its rows; wide rows are cheaper read twice than stored
            chosen = _selected(ddl_corpus, options)
            if options.text_store and not (options.schema_links or options.semantic_links):
                texts = text_store.ddl_texts(chosen, options.text_store, options.style)
                parts.append(corpora.from_ddl(chosen, options.style, options.drop_empty, known=texts))
            else:
                catalog = corpora.ddl_catalog(chosen)
                examples = corpora.from_ddl(
                    chosen, options.style, options.drop_empty, catalog, similar(catalog)
                )
                parts.append(records(examples, catalog))
        writers.write_corpus(corpora.combine(*parts), folder, options.formats, options.seed)
    return corpora.summary(spark.read.parquet(f"{folder}/datasets"))


def candidate_report(examples: DataFrame, candidates: DataFrame) -> dict[str, DataFrame]:
    """Choice among decoded candidates and how good it is, overall and by method.

    ``examples(example_id, gold_sql)``, ``candidates(example_id, ord, sql, executed)``.
    """
    chosen = C.select_candidate(examples, C.distinct_candidates(candidates))
    pairs = chosen.withColumnRenamed("sql", "pred_sql").join(examples, "example_id")
    selected = settle(evaluate.with_exact_match(pairs), "selected")
    counts = selected.rollup("method").agg(
        F.count("*").alias("examples"), F.count_if("exact_match").alias("em_correct")
    )
    rates = counts.withColumn("em_accuracy", percent(F.col("em_correct"), F.col("examples")))
    return {"selected": selected, "rates": C.method_rates(selected), "by_method": rates}


def evaluation_report(predictions: DataFrame, train: DataFrame) -> dict[str, DataFrame]:
    """All reports over ``predictions`` (see ``operators.evaluate``).

    The verdicts are stored first; each report reads the columns it needs.
    """
    scored = settle(evaluate.verdicts(predictions), "verdicts")
    return {
        "verdicts": scored,
        "overall": evaluate.overall(scored),
        "by_database": evaluate.by_database(scored, train),
        "by_operation": evaluate.by_operation(scored),
        "by_complexity": evaluate.by_complexity(scored),
        "worst": evaluate.worst(scored),
    }
