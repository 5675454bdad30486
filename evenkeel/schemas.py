"""Fixed schemas of the logs and tables the operators work on. Units are in the column names."""

from pyspark.sql import types as T

# How a task's input was read.
READ_METHODS = ("Memory", "Disk", "Hadoop", "Network")


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_LONG, _DOUBLE, _STRING, _BOOL, _TIME = (
    T.LongType(),
    T.DoubleType(),
    T.StringType(),
    T.BooleanType(),
    T.TimestampType(),
)

# `remaining_ids` and `processed_ids` may be missing from a log; both arrays are optional payload.
HEARTBEATS = _schema(
    executor_id=_LONG,
    hb_ts=_TIME,
    hb_seq=_LONG,
    remaining=_LONG,
    processed=_LONG,
    avg_rate=_DOUBLE,
    delta=_LONG,
    stolen_by=_LONG,
    stolen_from=_LONG,
    remaining_ids=T.ArrayType(_LONG),
    processed_ids=T.ArrayType(_LONG),
)

# Rows with a null `queue_id` form the shared pool.
WORK_ITEMS = _schema(item_id=_LONG, queue_id=_LONG, pos=_LONG, cost_ms=_LONG)

COMPLETIONS = _schema(item_id=_LONG, executor_id=_LONG, finish_ts=_TIME)

SHUFFLE_READ = _schema(
    fetch_wait_ms=_LONG,
    local_blocks=_LONG,
    remote_blocks=_LONG,
    remote_bytes=_LONG,
    shuffle_finish_ms=_LONG,
)

SHUFFLE_WRITE = _schema(bytes=_LONG, write_ns=_LONG)

INPUT_READ = _schema(read_method=_STRING, bytes_read=_LONG)

TASK_METRICS = _schema(
    task_id=_LONG,
    hostname=_STRING,
    executor_deserialize_ms=_LONG,
    executor_run_ms=_LONG,
    result_size_bytes=_LONG,
    jvm_gc_ms=_LONG,
    result_serialization_ms=_LONG,
    memory_bytes_spilled=_LONG,
    disk_bytes_spilled=_LONG,
    input=INPUT_READ,
    shuffle_read=SHUFFLE_READ,
    shuffle_write=SHUFFLE_WRITE,
)

SHUFFLE_DEPS = _schema(
    task_id=_LONG,
    dep_id=_LONG,
    fetch_wait_ms=_LONG,
    local_blocks=_LONG,
    remote_blocks=_LONG,
    remote_bytes=_LONG,
    shuffle_finish_ms=_LONG,
)

EXECUTORS = _schema(executor_id=_LONG, host=_STRING, rack=_STRING, active=_BOOL)

TASKS = _schema(task_id=_LONG, task_set_id=_LONG, executor_id=_LONG)

MOVES = _schema(victim_id=_LONG, thief_id=_LONG)

# One row per item handed over.
MOVE_LOG = _schema(item_id=_LONG, victim_id=_LONG, thief_id=_LONG)
