"""Fixed vocabularies of the SQL feature model.

Everything in this module is a fixed value: the operator names, their types
and abbreviations, the clause names and abbreviations and the category
orders are the ones the profiled corpora are reported in, so they must not be
renamed or reordered.
"""

# --- fixed values: clauses in category order (name, abbreviation) ---
CLAUSES = [
    ("select", "S"),
    ("from", "F"),
    ("where", "W"),
    ("groupby", "G"),
    ("having", "H"),
    ("orderby", "O"),
    ("limit", "L"),
]
SET_OPERATOR = ("set_operator", "SO")
NESTING = ("nesting", "N")
SET_OPERATORS = ["intersect", "union", "except"]

# --- fixed values: operator types in category order (name, abbreviation, members) ---
OPERATOR_TYPES = [
    ("join", "J", ["join", "left join", "inner join", "cross join", "left outer join"]),
    ("aggregate", "Ag", ["count", "min", "max", "sum", "avg"]),
    ("comparison_operator", "C", ["gt", "gte", "lt", "lte", "eq", "neq", "between", "not_between"]),
    ("logical_operator", "Lo", ["and", "or", "not"]),
    ("like_operator", "Li", ["like", "not_like", "ilike"]),
    ("arithmetic_operator", "Ar", ["sub", "add", "mul", "div"]),
    ("membership_operator", "Me", ["in", "nin"]),
    ("null_operator", "Nu", ["is null", "is not null", "exists"]),
]

# --- fixed values: comparison / arithmetic symbols ---
COMPARISON_SYMBOLS = {">": "gt", ">=": "gte", "<": "lt", "<=": "lte", "=": "eq", "!=": "neq", "<>": "neq"}
ARITHMETIC_SYMBOLS = {"-": "sub", "+": "add", "*": "mul", "/": "div"}
AGGREGATE_NAMES = ["count", "min", "max", "sum", "avg"]

# --- fixed values: reserved words that are never table/column identifiers ---
KEYWORDS = [
    "select", "from", "where", "group", "by", "having", "order", "limit", "offset",
    "asc", "desc", "and", "or", "not", "in", "like", "ilike", "between", "is", "null",
    "exists", "join", "left", "right", "inner", "outer", "cross", "full", "natural",
    "on", "using", "as", "distinct", "all", "union", "intersect", "except", "case",
    "when", "then", "else", "end", "true", "false", "count", "min", "max", "sum", "avg", "with", "recursive",
]

# Token pattern shared by Spark (Java regex) and the DuckDB oracle (RE2): comments first, then quoted strings so that
# nothing inside a literal is ever a keyword ('' is an escaped quote), numbers, (qualified, quoted) names, two-char
# operators, one-char symbols, and last any other character, which rejects the query (Q32).
_NUMBER = r"(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
_NAME = r'(?:[\p{L}_][\p{L}\p{N}_$]*|"[^"]*"|`[^`]*`)'
SYMBOL_PATTERN = r"<>|!=|>=|<=|\|\||[(),;*+/=<>%-]"
TOKEN_PATTERN = (
    r"--[^\n]*"
    r"|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"
    r"|'[^']*(?:''[^']*)*'"
    rf"|{_NUMBER}"
    rf"|{_NAME}(?:\.(?:{_NAME}|\*))*"
    rf"|{SYMBOL_PATTERN}"
    r"|[^ \t\n\x0B\f\r]"
)


def operator_names():
    """The 33 operator names in reporting order."""
    return [m for _, _, members in OPERATOR_TYPES for m in members]


def operator_column(name):
    """Column name used for an operator count (spaces become underscores)."""
    return name.replace(" ", "_")
