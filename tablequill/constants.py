"""Fixed values that define the data formats and rules."""

# --- Fixed values: words of a question that never name a schema element. ---
STOP_WORDS = [
    "how", "what", "where", "when", "why", "which", "who", "whom", "whose",
    "is", "are", "was", "were", "be", "been", "being", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might",
    "can", "the", "a", "an", "and", "or", "but", "if", "of", "to", "for",
    "with", "from", "by", "in", "on", "at", "as", "than", "that", "this",
    "these", "those", "many", "much", "more", "most", "some", "any", "all",
    "each", "every", "few", "several", "other", "another", "such", "same",
    "different", "old", "new", "first", "last", "next", "previous", "total",
    "number", "count", "sum", "average", "avg", "maximum", "max", "minimum",
    "min", "top", "bottom", "highest", "lowest", "largest", "smallest",
    "greater", "less", "equal", "older", "younger", "show", "list",
    "find", "get", "return", "give", "tell", "display", "present",
]

# --- Fixed values: name parts that carry no meaning on their own. ---
WEAK_WORDS = [
    "id", "key", "code", "number", "uuid", "guid", "no", "idx", "index",
    "pk", "fk", "ref", "num", "seq", "type", "flag", "status",
]

# --- Fixed values: codes of the logical query form. ---
AGGREGATES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
CONDITION_OPS = ["=", ">", "<", ">=", "<=", "!="]
PATTERNS = ["select_only", "where_only", "count", "sum", "avg", "max", "min"]

# --- Fixed values: folding of DDL types. ---
TEXT_TYPES = ["varchar", "char", "text", "string"]
NUMBER_TYPES = [
    "int", "integer", "bigint", "smallint", "number", "real", "float", "double", "decimal",
]

# --- Fixed values: pattern of one table in a DDL text. ---
DDL_TABLE_PATTERN = r"(?iU)CREATE\s+TABLE\s+(\w+)\s*\(([^)]+)\)"

# --- Fixed values: confidence of each kind of link, and the final limit. ---
EXACT_CONFIDENCE = 1.0
TABLE_PARTIAL_CONFIDENCE = 0.8
COLUMN_WORD_CONFIDENCE = 0.7
TEXT_VALUE_CONFIDENCE = 0.5
NAME_VALUE_CONFIDENCE = 0.8
DATE_VALUE_CONFIDENCE = 0.7
VALUE_THRESHOLD = 0.6
VECTOR_THRESHOLD = 0.7
MIN_CONFIDENCE = 0.65
SEMANTIC_LINKS_PER_SCHEMA = 5

# --- Fixed values: labels of the complexity report, in report order. ---
COMPLEXITY_LABELS = [
    "simple (1 table)",
    "medium (2 tables)",
    "complex (3-4 tables)",
    "very_complex (5+ tables or subquery)",
]

# --- Fixed values: operations of the operation report and their keywords. ---
OPERATION_KEYWORDS = {
    "has_join": ["JOIN"],
    "has_group_by": ["GROUP BY"],
    "has_having": ["HAVING"],
    "has_order_by": ["ORDER BY"],
    "has_limit": ["LIMIT"],
    "has_distinct": ["DISTINCT"],
    "has_aggregation": ["COUNT(", "SUM(", "AVG(", "MAX(", "MIN("],
    "has_where": ["WHERE"],
    "has_union": ["UNION", "INTERSECT", "EXCEPT"],
}

# --- Fixed values: errors of the syntax gate. ---
ERROR_EMPTY = "Empty or invalid SQL"
ERROR_NO_SELECT = "Missing SELECT keyword"
ERROR_NO_FROM = "Missing FROM keyword"

# --- Fixed values: texts that are part of the record formats. ---
INSTRUCTION = (
    "Given the following database schema and question, "
    "generate the SQL query that answers the question."
)
CHAT_SYSTEM = (
    "You are a SQL expert. Given a database schema and a natural language question, "
    "generate the correct SQL query to answer the question. "
    "Output only the SQL query without any explanation."
)
CHATML_SYSTEM = (
    "You are a SQL expert. Given a database schema and a natural language question, "
    "generate the correct SQL query. Output only the SQL query."
)
DEFAULT_QUESTION = "Generate SQL query"
UNKNOWN = "unknown"
