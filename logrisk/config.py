"""Vocabularies, codes and thresholds that define the results."""

# Keyword vocabularies (lower-case substrings of the message).
ERROR_KEYWORDS = [
    "exception", "error", "failed", "failure", "timeout", "refused",
    "denied", "corrupt", "lost", "unreachable", "killed", "oom",
    "outofmemory", "diskfull", "no space", "connection reset",
    "nullpointer", "classnotfound", "ioexception",
]
WARNING_KEYWORDS = [
    "warn", "retry", "slow", "delay", "high latency", "threshold",
    "deprecated", "fallback", "reconnect", "queue full",
]
CRITICAL_KEYWORDS = [
    "fatal", "critical", "abort", "terminate", "crash", "panic",
    "unrecoverable", "data loss", "corruption",
]
# Component substrings (case sensitive) that count as failing.
FAILING_COMPONENTS = [
    "DataNode", "NameNode", "BlockManager", "DataXceiver",
    "DFSClient", "FSNamesystem",
]

# Line format `yymmdd HHMMSS pid LEVEL component: message`.
LINE_PATTERN = r"^\s*\d{6}\s+\d{6}\s+\d+\s+\w+\s+\S+:\s+\S"
BLOCK_PATTERN = r"(blk_-?\d+)"
STOP_MARKER = "__PIPELINE_MONITOR_STOP__"

# Scheduler event codes.
EVENT_NAMES = {
    0: "SUBMIT",
    1: "SCHEDULE",
    2: "EVICT",
    3: "FAIL",
    4: "FINISH",
    5: "KILL",
    6: "LOST",
    7: "UPDATE_PENDING",
    8: "UPDATE_RUNNING",
}
FAIL_EVENTS = [2, 3, 5, 6]
FINISH_EVENT = 4
SCHEDULE_EVENT = 1

# Monitoring defaults and risk bands.
PREDICT_EVERY = 20
FLUSH_SECONDS = 30
RISK_HIGH = 0.70
RISK_MEDIUM = 0.40
EXPLANATION_SIZE = 5
TEST_SHARE = 0.25
FOLDS = 5

# Boosted-tree settings.
BOOSTING = {"maxIter": 300, "maxDepth": 5, "stepSize": 0.08, "subsamplingRate": 0.8}

# Conversion rates to USD and the columns an order must have.
USD_RATES = {"USD": 1.0, "EUR": 1.08, "GBP": 1.25, "NGN": 0.00067}
ORDER_COLUMNS = ["order_id", "customer_id", "order_date", "amount", "currency", "status"]

# Stage names looked for in free text, and level keywords in order.
STAGE_NAMES = ["Extract", "Validate", "Transform", "Load", "Report"]
LEVEL_KEYWORDS = {
    "FATAL": ["fatal", "critical", "panic", "abort", "terminate"],
    "ERROR": ["error", "failed", "failure", "exception", "timeout", "corrupt"],
    "WARN": ["warn", "warning", "retry", "slow", "fallback", "threshold", "queue full"],
}
# Component substrings per stage, first match wins.
COMPONENT_STAGES = [
    ("Extract", ["Extractor", "DataXceiver"]),
    ("Validate", ["SchemaValidator", "DFSClient"]),
    ("Clean", ["Cleaner"]),
    ("Transform", ["Transformer", "Aggregator"]),
    ("Load", ["Loader", "BlockManager", "NameNode"]),
    ("Audit", ["Auditor", "FSNamesystem"]),
    ("Commit", ["Committer"]),
    ("Report", ["Reporter", "Orchestrator"]),
]
TERMINAL_STATUSES = [
    "completed", "completed_with_high_risk", "failed", "failed_with_high_risk", "stopped", "error",
]

# Label texts of the tri-state label.
TRUE_LABELS = ["1", "1.0", "true", "yes", "failed", "fail"]
FALSE_LABELS = ["0", "0.0", "false", "no", "finished", "success"]

# Column orders of scheduler-event lines without a header.
EVENT_COLUMNS_12 = [
    "time", "missing_info", "job_id", "event_type", "user", "scheduling_class",
    "job_name", "logical_job_name", "priority", "cpu_request", "memory_request",
    "disk_space_request",
]
EVENT_COLUMNS_8 = [
    "time", "job_id", "event_type", "scheduling_class", "priority",
    "cpu_request", "memory_request", "disk_space_request",
]

# Names whose growth raises risk.
RISK_FEATURES = [
    "error_count", "error_rate", "error_kw_hits", "error_kw_rate",
    "fatal_count", "critical_rate", "retry_count", "exception_count",
    "max_error_burst", "err_x_retry", "failing_comp_hits",
    "has_exception", "has_fatal", "has_retry",
    "memory_request", "oom_signal", "timeout_signal",
    "log1p_error_count", "log1p_fatal_count",
    "log1p_retry_count", "log1p_exception_count",
    "log1p_err_x_retry", "log1p_max_error_burst",
]

# The canonical feature schema, in order.
COUNT_FEATURES = [
    "total_lines", "info_count", "warn_count", "error_count", "debug_count", "fatal_count",
    "error_kw_hits", "warning_kw_hits", "critical_kw_hits", "retry_count", "exception_count",
    "unique_components", "failing_comp_hits", "unique_pids", "max_error_burst",
    "hour_of_day", "is_weekend", "priority", "scheduling_class",
    "task_count", "failed_task_count", "event_count", "err_x_retry",
    "has_exception", "has_fatal", "has_retry", "oom_signal", "timeout_signal", "cluster",
]
VALUE_FEATURES = [
    "error_rate", "warn_rate", "critical_rate", "error_kw_rate", "duration_s",
    "cpu_request", "memory_request", "disk_request", "gpu_request", "instance_count",
    "failed_instance_count", "scheduling_delay_s", "cpu_usage_avg", "cpu_usage_max",
    "memory_usage_avg", "memory_usage_max", "cpu_usage_sample", "memory_usage_sample",
    "assigned_memory", "page_cache_memory", "cycles_per_instruction",
    "memory_accesses_per_instruction", "sample_rate",
]
# Columns that also come as log1p, in order.
LOG1P_COLUMNS = [
    "total_lines", "error_count", "warn_count", "fatal_count",
    "error_kw_hits", "retry_count", "exception_count",
    "duration_s", "err_x_retry", "max_error_burst",
]
# Columns beside the features, and the names of the sources.
METADATA = ["process_id", "group_id", "source", "label"]
SOURCES = ["hdfs", "google", "alibaba", "google2019"]
