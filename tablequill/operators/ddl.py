"""Tables of DDL texts with nested parentheses, quotes, comments and key clauses.

A text is cut into tokens: comments, table heads, quoted pieces, structural
marks, words. One pass over the tokens keeps the nesting depth and notes where
a definition is cut: at the head, at commas of depth one, and at the parenthesis
that closes the head's. Everything happens inside the row, with built-in
functions, in time proportional to the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablequill.functions.text import one_of

_QUOTED = r'"(?:[^"]|"")*"|`(?:[^`]|``)*`|\[[^\]]*\]'
_NAME = rf"(?:{_QUOTED}|[\p{{L}}_][\p{{L}}\p{{N}}_$#]*)"
_COMMENT = r"--[^\n]*|/\*(?s:.*?)\*/"
_HEAD = (
    r"\bCREATE\s+(?:(?:GLOBAL|LOCAL|TEMP|TEMPORARY|UNLOGGED|EXTERNAL|FOREIGN)\s+)*TABLE\s+"
    rf"(?:IF\s+NOT\s+EXISTS\s+)?{_NAME}(?:\s*\.\s*{_NAME})*\s*\("
)
_TOKEN = rf"(?iU){_COMMENT}|{_HEAD}|'(?:[^']|'')*'|{_QUOTED}|[(),;]|\s+|[^\s(),;'\"`\[/-]+|(?s:.)"

# Clauses of a table that are no columns. KEY and INDEX may also name a column; the
# clauses have a list of names behind them, types a list of numbers.
_CLAUSE = (
    r"(?iU)^(?:CONSTRAINT\s|PRIMARY\s+KEY\b|FOREIGN\s+KEY\b|CHECK\s*\(|EXCLUDE\s|LIKE\s|PERIOD\s+FOR\b"
    rf"|(?:UNIQUE|UNIQUE\s+KEY|UNIQUE\s+INDEX|(?:FULLTEXT\s+|SPATIAL\s+)?(?:KEY|INDEX))\s*(?:{_NAME}\s*)?"
    r"(?:USING\s+\w+\s*)?\((?!\s*\d+\s*(?:,\s*\d+\s*)?\)))"
)
# Words that may follow a column name where a type is missing.
_NO_TYPE = [
    "primary", "not", "null", "unique", "default", "check", "references", "constraint", "collate",
    "generated", "auto_increment", "autoincrement", "comment", "foreign", "on",
]
_LIST = r"\(\s*([^()]*(?:\([^()]*\)[^()]*)*)\)"


def unquoted(name: Column) -> Column:
    """A name without its quotes; doubled quotes inside stand for one."""
    inner = F.substring(name, F.lit(2), F.length(name) - 2)
    return (
        F.when(name.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"')))
        .when(name.startswith("`"), F.replace(inner, F.lit("``"), F.lit("`")))
        .when(name.startswith("["), inner)
        .otherwise(name)
    )


def _names(text: Column) -> Column:
    """Names of a list in parentheses, without lengths and directions."""
    found = F.regexp_extract_all(text, F.lit(rf"(?iU)(?:^|,)\s*({_NAME})"), F.lit(1))
    return F.transform(found, unquoted)


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match, NULL if there is none or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _cuts(tokens: Column) -> Column:
    """Where definitions are cut, as ``:place:kind:table:place:kind:table...``.

    Kind 0 is a head, 1 a comma of depth one, 2 the end. A text that ends, or
    meets a semicolon or another head, inside a table ends that table there.
    """
    # the cuts are written as text: appending to an array copies it element by element
    start = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("def"), F.lit(0).alias("at"), F.lit("").alias("cuts"))

    def step(a: Column, t: Column) -> Column:
        depth, number, at = a["depth"], a["def"], a["at"]
        head = t.endswith("(") & (F.length(t) > 1) & F.lower(t).startswith("create")
        end = (depth == 1) & (t == ")") | (depth > 0) & (t == ";")
        comma = (depth == 1) & (t == ",")
        kind = F.when(head, 0).when(comma, 1).when(end, 2)
        after = (
            F.when(head, 1).when(end, 0).when((depth > 0) & (t == "("), depth + 1)
            .when((depth > 0) & (t == ")"), depth - 1).otherwise(depth)
        )
        table = F.when(head, number + 1).otherwise(number)
        cut = F.concat_ws(":", a["cuts"], at.cast("string"), kind.cast("string"), table.cast("string"))
        return F.struct(
            after.alias("depth"), table.alias("def"), (at + 1).alias("at"),
            F.when(kind.isNotNull(), cut).otherwise(a["cuts"]).alias("cuts"),
        )

    return F.aggregate(
        tokens, start, step, lambda a: F.concat_ws(":", a["cuts"], F.size(tokens).cast("string"), F.lit("2:-1"))
    )


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns that expressions above read as often as they like: Spark does not
    move an expression through a generator, so each is computed once per row."""
    one = F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))
    return df.select("*", F.explode(one).alias("_once")).select("*", "_once.*").drop("_once")


def _item(text: Column) -> Column:
    """What one piece between two cuts says: a column, keys, or a reference."""
    plain = F.regexp_replace(text, r"'(?:[^']|'')*'", "''")
    clause = F.rlike(plain, F.lit(_CLAUSE))
    rest = F.regexp_replace(plain, rf"(?iU)^CONSTRAINT\s+(?:{_NAME}\s+)?(?=PRIMARY|FOREIGN|UNIQUE|CHECK)", "")
    keys = F.when(clause, _group(rest, rf"(?iU)^PRIMARY\s+KEY\s*(?:CLUSTERED|NONCLUSTERED)?\s*{_LIST}"))
    table_from = F.when(clause, _group(rest, rf"(?iU)^FOREIGN\s+KEY\s*(?:{_NAME}\s*)?{_LIST}"))
    name = _group(plain, rf"^\s*({_NAME}|\S+)")
    word = F.lower(_group(plain, rf"(?U)^\s*(?:{_NAME}|\S+)\s+(\w+)"))
    raw_type = F.when(~one_of(F.coalesce(word, F.lit("default")), _NO_TYPE), word)
    to = rf"(?iU)\bREFERENCES\s+((?:{_NAME}\s*\.\s*)*{_NAME})"
    to_table = F.element_at(
        F.regexp_extract_all(F.regexp_extract(plain, to, 1), F.lit(rf"(?U){_NAME}"), F.lit(0)), -1
    )
    has_target = F.rlike(plain, F.lit(to))
    return F.struct(
        F.when(~clause, unquoted(name)).alias("col_name"),
        raw_type.alias("raw_type"),
        (~clause & F.rlike(plain, F.lit(r"(?i)\bPRIMARY\s+KEY\b"))).alias("is_pk"),
        _names(F.coalesce(keys, F.lit(""))).alias("keys"),
        F.when(has_target, F.struct(
            F.when(clause, _names(F.coalesce(table_from, F.lit("")))).otherwise(F.array(unquoted(name))).alias("columns"),
            unquoted(to_table).alias("to_table"),
            _names(F.coalesce(_group(plain, to + rf"\s*{_LIST}", 2), F.lit(""))).alias("to_columns"),
        )).alias("target"),
    )


def definitions(ddls: DataFrame, fold) -> DataFrame:
    """(schema_id, def_ord, table_name, table_ord, is_last, cols, targets) of every table.

    ``ddls(schema_id, ddl)``; ``fold`` maps a type as written to the type of a
    column. Names keep their case and lose quotes and the names of schemas before
    them. Table-level keys mark their columns and are no columns. A table without
    columns has an empty ``cols``; a name that is defined again keeps its first
    place (``table_ord``), and only its last definition counts (``is_last``).
    """
    tokens = _once(
        ddls.select("schema_id", "ddl"), tokens=F.regexp_extract_all("ddl", F.lit(_TOKEN), F.lit(0))
    ).where(F.col("tokens").isNotNull())
    numbers = F.split(F.substring(F.col("found"), 2, 1 << 30), ":").cast("array<int>")
    cut = _once(_once(tokens, found=_cuts(F.col("tokens"))), numbers=numbers)
    every = F.arrays_zip(*[
        F.expr(f"filter(numbers, (n, i) -> i % 3 = {k})").alias(c)
        for k, c in enumerate(("at", "kind", "def"))
    ])
    cut = _once(cut, cuts=every)

    def piece(c: Column, i: Column) -> Column:
        inside = F.slice("tokens", c["at"] + 2, F.get("cuts", i + 1)["at"] - c["at"] - 1)
        kept = F.filter(inside, lambda t: ~(t.startswith("--") | t.startswith("/*")))
        text = F.trim(F.regexp_replace(F.array_join(kept, ""), r"\s+", " "))
        return F.struct(c["kind"].alias("kind"), c["def"].alias("def"), text.alias("text"))

    heads = F.transform(
        F.filter("cuts", lambda c: c["kind"] == 0), lambda c: F.element_at("tokens", c["at"] + 1)
    )
    parts = F.lit(rf"(?iU)(?<=TABLE\s|EXISTS\s|\.|\s){_NAME}(?=\s*[.(])")
    names = F.transform(
        heads, lambda h: unquoted(F.element_at(F.regexp_extract_all(h, parts, F.lit(0)), -1))
    )
    until = F.slice("cuts", F.lit(1), F.size("cuts") - 1)
    parsed = _once(cut, names=names, pieces=F.transform(until, piece))
    # one row per table carries only its own pieces
    starts = F.filter("pieces", lambda p: p["kind"] == 0)
    first = F.transform(starts, lambda p: F.array_position(F.transform("pieces", lambda q: q["def"]), p["def"]))
    parsed = _once(parsed, first=first).select("schema_id", "names", "pieces", "first", F.posexplode("names").alias("def_ord", "table_name"))
    after = F.coalesce(F.get("first", F.col("def_ord") + 1), F.size("pieces") + 1)
    begin = F.get("first", F.col("def_ord")).cast("int")
    own = F.slice("pieces", begin, after.cast("int") - begin)
    mine = F.filter(own, lambda p: (p["kind"] != 2) & (p["text"] != ""))
    items = _once(parsed, items=F.transform(mine, lambda p: _item(p["text"])))
    items = _once(items, keys=F.transform(F.flatten(F.transform("items", lambda x: x["keys"])), F.lower))
    numbered = F.transform(
        F.filter("items", lambda x: x["col_name"].isNotNull()),
        lambda x, i: F.struct(
            i.alias("col_ord"), x["col_name"].alias("col_name"), fold(x["raw_type"]).alias("dtype"),
            (x["is_pk"] | F.array_contains("keys", F.lower(x["col_name"]))).alias("is_pk"),
        ),
    )
    last = F.size("names") - F.array_position(F.reverse("names"), F.col("table_name"))
    return items.select(
        "schema_id", "def_ord", "table_name",
        (F.array_position("names", F.col("table_name")) - 1).cast("int").alias("table_ord"),
        (last == F.col("def_ord")).alias("is_last"),
        numbered.alias("cols"),
        F.transform(
            F.filter("items", lambda x: x["target"].isNotNull()), lambda x: x["target"]
        ).alias("targets"),
    )


def declared_foreign_keys(found: DataFrame, columns: DataFrame) -> DataFrame:
    """(schema_id, fk_ord, from_table, from_column, to_table, to_column) of REFERENCES clauses.

    Names match in any case and come out as the tables spell them; a reference
    without columns points at the target's first key column. References to
    tables or columns that the text does not define are left out.
    """
    targets = found.where("is_last").select(
        "schema_id", "def_ord", F.col("table_name").alias("from_table"),
        F.posexplode("targets").alias("place", "t"),
    )
    pairs = targets.select(
        "schema_id", "from_table", F.lower("t.to_table").alias("to"),
        (F.col("def_ord").cast("long") * (1 << 20) + F.col("place") * (1 << 8)).alias("base"),
        F.posexplode("t.columns").alias("i", "column"), F.col("t.to_columns").alias("to_columns"),
    ).select(
        "schema_id", "from_table", "to", (F.col("base") + F.col("i")).alias("fk_ord"),
        F.lower("column").alias("from_low"), F.lower(F.get("to_columns", F.col("i"))).alias("to_low"),
    )
    position = F.struct(F.col("col_ord").alias("o"), F.col("col_name").alias("n"))
    named = columns.groupBy("schema_id", F.lower("table_name").alias("low"), F.lower("col_name").alias("col_low")).agg(
        F.min_by("table_name", "table_ord").alias("table_name"), F.min(position).alias("column")
    )
    first_key = columns.where("is_pk").groupBy("schema_id", F.lower("table_name").alias("to")).agg(
        F.min(position)["n"].alias("key_column")
    )
    source = named.select(
        "schema_id", F.col("table_name").alias("from_table"), F.col("col_low").alias("from_low"),
        F.col("column.n").alias("from_column"),
    )
    target = named.select(
        "schema_id", F.col("low").alias("to"), F.col("col_low").alias("to_low"),
        F.col("table_name").alias("to_table"), F.col("column.n").alias("to_column"),
    )
    return (
        pairs.join(first_key, ["schema_id", "to"], "left")
        .withColumn("to_low", F.coalesce("to_low", F.lower("key_column")))
        .join(source, ["schema_id", "from_table", "from_low"])
        .join(target, ["schema_id", "to", "to_low"])
        .select("schema_id", "fk_ord", "from_table", "from_column", "to_table", "to_column")
    )
