"""Word lists, patterns and labels that results are defined by."""

# --- Fixed values: expression language -------------------------------------------------
EL = r"\$\{[^}]+\}"
EL_BODY = r"\$\{([^}]+)\}"
QUERY_REF = r"\$\{(query_\d+(?:_[A-Za-z][A-Za-z0-9_]*)?)\}"

# --- Fixed values: SQL clause patterns of table extraction (clause, confidence, pattern) --
IDENT = r"([a-zA-Z_][a-zA-Z0-9_.]*)"
SQL_CLAUSES = [
    ("from", 0.9, r"\bFROM\s+" + IDENT),
    ("join", 0.9, r"\b(?:INNER\s+|LEFT\s+|RIGHT\s+|FULL\s+|CROSS\s+)?JOIN\s+" + IDENT),
    ("insert", 0.95, r"\bINSERT\s+INTO\s+(?:TABLE\s+)?" + IDENT),
    ("update", 0.95, r"\bUPDATE\s+" + IDENT),
    ("create", 0.98, r"\bCREATE\s+(?:EXTERNAL\s+)?TABLE\s+IF\s+NOT\s+EXISTS\s+" + IDENT),
    ("create", 0.98, r"\bCREATE\s+(?:EXTERNAL\s+)?TABLE\s+(?!IF\s+NOT\s+EXISTS)" + IDENT),
    ("drop", 0.8, r"\bDROP\s+TABLE\s+(?:IF\s+EXISTS\s+)?" + IDENT),
    ("alter", 0.8, r"\bALTER\s+TABLE\s+" + IDENT),
    ("truncate", 0.8, r"\bTRUNCATE\s+(?:TABLE\s+)?" + IDENT),
    ("delete", 0.9, r"\bDELETE\s+FROM\s+" + IDENT),
    ("merge", 0.8, r"\bMERGE\s+(?:INTO\s+)?" + IDENT),
    ("with", 0.3, r"\bWITH\s+" + IDENT + r"\s+AS"),
]
# Clauses seen by the lineage patterns only; added to extraction unless compat=True.
SQL_CLAUSES_EXTRA = [
    ("insert", 0.95, r"\bINSERT\s+OVERWRITE\s+(?:TABLE\s+)?" + IDENT),
    ("create", 0.98, r"\bCREATE\s+OR\s+REPLACE\s+TABLE\s+" + IDENT),
]
WRITE_CLAUSES = ["insert", "update", "delete", "create", "drop", "alter", "truncate", "merge"]

# --- Fixed values: lineage read / write patterns -----------------------------------------
PART = r"(?:[`\"\[]?[A-Za-z_][\w$]*[`\"\]]?)"
QUALIFIED = rf"((?:{PART}\.)?{PART}(?:\.{PART})?)"
READ_PATTERNS = [
    r"\bfrom\s+" + QUALIFIED,
    r"\bjoin\s+" + QUALIFIED,
    r"\bmerge\s+into\s+" + QUALIFIED,
]
WRITE_PATTERNS = [
    r"\binsert\s+(?:into|overwrite\s+table)\s+" + QUALIFIED,
    r"\bcreate\s+(?:or\s+replace\s+)?table\s+" + QUALIFIED,
    r"\btruncate\s+table\s+" + QUALIFIED,
    r"\brefresh\s+" + QUALIFIED,
    r"\balter\s+table\s+" + QUALIFIED,
    r"\bmerge\s+into\s+" + QUALIFIED,
]
ALIAS_LETTERS = "abcdefghijkmpqrtuvwxyz"
FILE_LIKE_LAST_PARTS = ["path", "file", "absolute", "sh", "py", "jar", "xml"]
FILE_LIKE_TOKENS = [".sh", ".py", ".jar", ".class", ".xml", ".keytab", ".com", ".error", ".log", ".txt", ".csv"]
CAPTURED_KEYWORDS = ["select", "where", "order", "group", "by", "join", "from", "when", "case", "then", "else", "end"]
CONTROL_SCHEMAS = ["root", "absolute", "file", "text", "impala"]
LINEAGE_SKIP_TYPES = ["updateattribute", "logmessage", "wait", "routeonattribute"]
SQL_BEARING_TYPES = ["executesql", "putsql", "executestreamcommand", "puthiveql"]

# --- Fixed values: table-name scoring ----------------------------------------------------
TABLE_PROPERTY_WORDS = ["table", "collection", "topic", "index", "bucket", "schema", "dataset", "model"]
SQL_PROPERTY_WORDS = ["sql", "query", "statement", "command"]
WRITER_TYPES = ["putsql", "puthive", "putdatabaserecord", "putrecord", "putdatabase", "putpostgresql"]
READER_TYPES = ["querydatabasetable", "generatetablefetch", "selecthiveql", "fetch"]
TARGET_PROPERTY_WORDS = ["output", "target", "destination", "landing"]
INHERITING_TYPES = ["executestreamcommand", "putsql", "puthiveql", "putdatabaserecord", "putdatabase", "putdatabasetable"]
NAME_SHAPES = [
    r"^[a-z_]+_(?:table|tbl|data|log|hist|temp|staging)$",
    r"^(?:dim|fact|stage|temp|raw|clean)_[a-z_]+$",
    r"^[a-z]+\.[a-z_]+$",
    r"^[a-z_]+(?:_[0-9]+)?$",
    r"^[a-z_]{3,20}$",
]
TABLE_WORDS = [
    "table", "tbl", "data", "log", "hist", "temp", "staging", "archive", "backup", "cache", "queue",
    "event", "audit", "dim", "fact", "raw", "clean", "processed", "transformed",
]
DOMAIN_WORDS = [
    "user", "customer", "order", "product", "invoice", "payment", "transaction", "account", "profile",
    "session", "metric", "stdf", "probe", "wafer", "lot", "unit", "test", "measurement",
]
DATA_PROCESSOR_WORDS = ["hbase", "sql", "jdbc", "mongo", "cassandra", "hive", "executesql"]
SCORED_PROPERTY_WORDS = ["table", "collection", "dataset", "model", "schema"]
SCORE_THRESHOLD = 0.35
NOT_TABLES = [
    "select", "from", "where", "join", "inner", "left", "right", "outer", "full", "union", "order",
    "group", "having", "limit", "offset", "distinct", "count", "sum", "avg", "max", "min", "case",
    "when", "then", "else", "end", "as", "and", "or", "not", "null", "true", "false", "exists", "in",
    "between", "like", "is", "desc", "asc", "by", "into", "values", "insert", "update", "delete",
    "create", "drop", "alter", "table", "index", "view", "database", "schema", "column", "primary",
    "foreign", "key", "constraint", "default", "auto_increment", "unique", "cascade", "on",
    "references", "check", "because", "dates", "grps", "leadlag", "now", "startgrouping", "if",
    "prod_table", "staging_table", "external_table", "entity", "table_name", "database_name",
    "schema_name", "connection_url", "driver_class", "host", "port", "username", "password",
    "yes", "no", "none", "empty", "auto", "manual", "enabled", "disabled", "active", "inactive",
]

# --- Fixed values: scripts ---------------------------------------------------------------
SCRIPT_EXTENSIONS = [".sh", ".py", ".sql", ".jar", ".class", ".scala", ".R", ".pl", ".rb"]
SCRIPT_PATH = r"/[\w/.-]+\.(?:sh|py|sql|jar|class|scala|R|pl|rb)"
SCRIPT_TYPE_BY_EXTENSION = {
    "sh": "shell_script",
    "py": "python_script",
    "sql": "sql_script",
    "jar": "java_application",
    "class": "java_class",
    "scala": "scala_script",
    "r": "r_script",
    "pl": "perl_script",
    "rb": "ruby_script",
}
SCRIPT_TYPE_HINTS = [
    "executescript", "invokescriptedprocessor", "executestreamcommand", "scriptedlookupservice",
    "scriptedrecordreader", "scriptedrecordsetwriter", "jolttransformjson", "executegroovyscript",
]
SCRIPT_NAME_HINTS = [
    "script", "script body", "script text", "script code", "query", "sql", "statement", "hql",
    "command", "command arguments", "args", "groovy", "jython", "python", "javascript", "inline",
    "expression", "spec", "query_1", "query_2", "query_3", "query_4", "query_5",
]
CODE_TOKENS = [
    r"\b(def|function|class)\b", r"[{};]", r"^\s*(import|from)\s+", r"#!/", r"\bSELECT\b",
    r"\bINSERT\b", r"\bALTER\b", r"\|\s*grep\b", r"\bawk\b", r"\bsed\b",
]
COMMAND_CONFIG_WORDS = [
    "ignore stdin", "output destination attribute", "max attribute length", "argumentsstrategy",
    "argument delimiter", "working directory", "command path",
]
LANGUAGE_SIGNATURES = [
    ("sql", [
        r"\bSELECT\b.*\bFROM\b", r"\bINSERT\s+INTO\b", r"\bUPDATE\s+.*\bSET\b", r"\bCREATE\s+TABLE\b",
        r"\bALTER\s+TABLE\b", r"\bDROP\s+.*\bPARTITION\b", r"\bTRUNCATE\s+TABLE\b", r"\bREFRESH\b",
        r"\bWITH\b.*\bAS\s*\(",
    ]),
    ("bash", [
        r"^\s*#!/bin/(ba)?sh", r"\b(echo|grep|awk|sed)\b", r"\|\s*(grep|awk|sed)\b",
        r"impala-shell.*-q", r"-[A-Za-z]+;",
    ]),
    ("python", [
        r"\bdef\s+\w+\s*\(", r"\bimport\s+\w+", r"\bfrom\s+.*\bimport\b", r"if\s+__name__\s*==",
    ]),
    ("groovy", [r"@Grab\(", r"\bprintln\s*\(", r"groovy\."]),
    ("jolt", [r"^\s*\[?\s*\{", r'"operation"\s*:', r'"shift"']),
]
# Secret patterns use a real whitespace class (see README, "Decisions").
SECRET_PATTERNS = [
    (r"\b(password|passwd|pwd|secret|token|apikey)\s*=\s*['\"]?([^'\"\s]+)['\"]?", "{1}='***'"),
    (r"aws_secret_access_key\s*=\s*['\"]?[^'\"\s]+['\"]?", "aws_secret_access_key='***'"),
    (r"jdbc:[^\s]+:([^@]+)@", "jdbc:***:***@"),
]
ERROR_WORDS = ["failed", "error", "exception", "unable to", "cannot", "not found"]
CONFIG_WORDS = ["true", "false", "null", "none", "auto", "default"]
URL_HOST = r"https?://([^/\s]+)"
DOMAIN_HOST = r"\b((?:[a-zA-Z0-9-]+\.){1,}[a-zA-Z]{2,})\b"
SKIPPED_HOSTS = ["example.com", "localhost", "test.com"]
PREVIEW_CHARS = 800
REVIEW_NOTE = "External file – review content separately before migration."
INLINE_PROPERTY_WORDS = [
    "script body", "script_body", "scriptbody", "script content", "script_content", "scriptcontent",
    "script text", "script_text", "scripttext", "script code", "script_code", "scriptcode", "query",
    "sql", "statement", "command body", "command_body", "commandbody", "python script",
    "python_script", "pythonscript", "shell script", "shell_script", "shellscript", "groovy script",
    "groovy_script", "groovyscript",
]
INLINE_INDICATORS = [
    r"import\s+\w+", r"from\s+\w+\s+import", r"def\s+\w+\s*\(", r"if\s+__name__\s*==",
    r"#!/bin/(bash|sh)", r"echo\s+", r"for\s+\w+\s+in", r"if\s*\[\s*.+\s*\]", r"SELECT\s+",
    r"INSERT\s+INTO", r"UPDATE\s+", r"CREATE\s+TABLE", r"FROM\s+\w+", r"public\s+class",
    r"import\s+java\.", r"System\.out\.print", r"\{\s*\n.*\n.*\}", r"=\s*function\s*\(", r"var\s+\w+\s*=",
]
INLINE_LANGUAGES = [
    ("python", r"import\s+\w+|def\s+\w+|python"),
    ("shell", r"#!/bin/(bash|sh)|echo\s+|bash|shell"),
    ("sql", r"SELECT|INSERT|UPDATE|CREATE|sql"),
    ("java_groovy", r"import\s+java|public\s+class|groovy"),
]

# --- Fixed values: variables -------------------------------------------------------------
DEFINING_TYPES = ["UpdateAttribute", "EvaluateJsonPath", "ExtractText"]
EXTRACT_TEXT_SETTINGS = [
    "Character Set", "Maximum Buffer Size", "Maximum Capture Group Length",
    "Enable Canonical Equivalence", "Enable Case-insensitive Matching",
    "Permit Whitespace and Comments in Pattern", "Enable DOTALL Mode",
    "Enable Literal Parsing of the Pattern", "Enable Multiline Mode",
    "Enable Unicode-aware Case Folding", "Enable Unicode Predefined Character Classes",
    "Enable Unix Lines Mode", "Include Capture Group 0",
    "extract-text-enable-repeating-capture-group", "extract-text-enable-named-groups",
]

# --- Fixed values: features and categories -----------------------------------------------
DML = r"\b(INSERT|UPDATE|DELETE|MERGE|UPSERT)\b"
METADATA_SQL = r"\b(REFRESH|MSCK|ANALYZE|DESCRIBE|SHOW\s+TABLES|SHOW\s+PARTITIONS)\b"
BUSINESS, SOURCE, SINK = "Business Logic", "Source Adapter", "Sink Adapter"
ORCHESTRATION, INFRASTRUCTURE, AMBIGUOUS = "Orchestration / Monitoring", "Infrastructure Only", "Ambiguous"
ESSENTIAL_CATEGORIES = [BUSINESS, SOURCE, SINK]
PROMOTABLE_CATEGORIES = [INFRASTRUCTURE, ORCHESTRATION]
CONSUMER_CATEGORIES = [BUSINESS, SINK]
PROMOTION_TARGET = "Variable setup"
PROMOTION_FLOOR = 0.6
OVERRIDE_FLOOR = 0.95
OVERRIDE_TARGETS = {
    BUSINESS: "Manual business task",
    SOURCE: "Databricks ingestion task",
    SINK: "Delta or external sink task",
    ORCHESTRATION: "Workflow support",
    INFRASTRUCTURE: "Workflow plumbing",
}
NEIGHBOR_TYPES = [
    "ExecuteSQL", "PutSQL", "PutFile", "PutHDFS", "ListFile", "ListSFTP", "FetchFile", "FetchSFTP",
    "ExecuteScript", "InvokeScriptedProcessor", "ExecuteStreamCommand", "RouteOnAttribute",
    "UpdateAttribute", "LogMessage", "ControlRate", "ListenHTTP", "Wait", "GenerateFlowFile",
    "ReplaceText", "ExtractText", "EvaluateJsonPath", "GetFile", "PutKudu", "PutHiveStreaming",
    "PutKafka",
]
NAME_KEYWORDS = {"name_has_log": ["log", "logging"], "name_has_retry": ["retry", "requeue"], "name_has_sftp": ["sftp"]}
GROUP_KEYWORDS = {"group_has_alert": ["alert", "monitor"]}
CONTROLLER_KEYWORDS = {
    "uses_dbcp": ["dbcp"], "uses_kafka": ["kafka"], "uses_jms": ["jms"],
    "uses_hive": ["hive"], "uses_impala": ["impala"], "uses_kudu": ["kudu"],
}
SUMMARY_COLUMNS = [
    "template", "template_path", "processor_id", "processor_name", "processor_type", "short_type",
    "parent_group", "parent_group_path", "migration_category", "databricks_target", "confidence",
    "classification_source", "rule", "sql_has_dml", "sql_has_metadata_only", "scripts_inline_count",
    "scripts_external_count", "uses_variables", "incoming_count", "outgoing_count",
]
TABLE_REF_COLUMNS = [
    "source_file", "source_path", "table_name", "processor_name", "processor_type", "processor_id", "processor_group",
    "property_name",
]
SCRIPT_COLUMNS = ["source_file", "processor_name", "processor_id", "script_type", "source", "property_name"]
DEPENDENCY_NAME_WORDS = ["Add Queries", "Add Configuration", "Add Variables", "States", "Steps"]

# --- Fixed values: the shipped ordered rulebook ------------------------------------------
DEFAULT_RULES = [
    {
        "name": "ExecuteSQL DML",
        "processor_short_types": ["ExecuteSQL", "PutSQL"],
        "conditions": [{"field": "sql.has_dml", "equals": True}],
        "migration_category": BUSINESS,
        "databricks_target": "Databricks SQL task (Delta write)",
        "confidence": 0.9,
        "notes": "Executes mutating SQL that must be reimplemented",
    },
    {
        "name": "ExecuteSQL Metadata Only",
        "processor_short_types": ["ExecuteSQL", "ExecuteStreamCommand"],
        "conditions": [{"field": "sql.has_metadata_only", "equals": True}],
        "migration_category": ORCHESTRATION,
        "databricks_target": "Databricks notebook (metadata refresh)",
        "confidence": 0.6,
        "notes": "Metadata or diagnostic SQL; treat as workflow step",
    },
    {
        "name": "Scripted Processor Inline",
        "processor_short_types": ["ExecuteScript", "InvokeScriptedProcessor", "ExecuteStreamCommand"],
        "conditions": [{"field": "scripts.inline_count", "gt": 0}],
        "migration_category": BUSINESS,
        "databricks_target": "Databricks Python notebook or task",
        "confidence": 0.85,
        "notes": "Inline script requires porting to Databricks",
    },
    {
        "name": "External Script Runner",
        "processor_short_types": ["ExecuteStreamCommand"],
        "conditions": [{"field": "scripts.external_count", "gt": 0}],
        "migration_category": SOURCE,
        "databricks_target": "Databricks workflow task calling external script or job",
        "confidence": 0.7,
        "notes": "Wrap external script invocation in Jobs or remove if obsolete",
    },
    {
        "name": "List/Fetch Sources",
        "processor_short_types": ["ListFile", "ListSFTP", "FetchFile", "FetchSFTP"],
        "migration_category": SOURCE,
        "databricks_target": "Autoloader / COPY INTO / Files API",
        "confidence": 0.8,
        "notes": "Replace with Databricks ingestion pattern",
    },
    {
        "name": "PutFile / PutHDFS",
        "processor_short_types": ["PutFile", "PutHDFS"],
        "migration_category": SINK,
        "databricks_target": "Delta write or Files API",
        "confidence": 0.75,
        "notes": "Map to Databricks managed storage",
    },
    {
        "name": "RouteOnAttribute / UpdateAttribute orchestration",
        "processor_short_types": ["RouteOnAttribute", "UpdateAttribute"],
        "migration_category": ORCHESTRATION,
        "databricks_target": "Databricks Jobs task branching / parameters",
        "confidence": 0.6,
        "notes": "Captures routing logic or variable wiring",
    },
    {
        "name": "Default infrastructure",
        "migration_category": INFRASTRUCTURE,
        "databricks_target": "N/A",
        "confidence": 0.2,
        "notes": "No matching rule; treat as infrastructure",
    },
]
NO_MATCH = {
    "name": "No Match",
    "migration_category": AMBIGUOUS,
    "databricks_target": "Needs review",
    "confidence": 0.0,
    "notes": "No declarative rule matched this processor",
}
