"""Record shapes shared by sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
_I = T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


# Numbers arrive as JSON numbers or as text, so they are read as text and cast by the normaliser.
ALERT = T.StructType(
    [
        T.StructField("id", _S),
        T.StructField("@timestamp", _S),
        T.StructField("timestamp", _S),
        T.StructField("rule", _struct(level=_S, id=_S, description=_S, groups=T.ArrayType(_S))),
        T.StructField("data", _struct(srcip=_S, dstport=_S, srcport=_S)),
        T.StructField("agent", _struct(name=_S, id=_S, ip=_S)),
        T.StructField("full_log", _S),
    ]
)

ALERT_ENVELOPE = _struct(hits=_struct(hits=T.ArrayType(_struct(_id=_S, _source=ALERT))))

EVENT = _struct(
    source_ip=_S, destination_ip=_S, port=_I, user=_S, event_type=_S, timestamp=_S, raw_log=_S,
    level=_I, rule_id=_S, severity=_I, label=_S, explanation=_S, status=_S,
)

RAW_LOG = _struct(log=_S, category=_S)

FIELD_LOG = _struct(
    timestamp=_S, src_ip=_S, source_ip=_S, dst_ip=_S, destination_ip=_S,
    event_type=_S, user=_S, message=_S,
)

RESULT_FIELDS = ["timestamp", "event_type", "source_ip", "severity", "label", "explanation"]

DASHBOARD_ALERT = _struct(
    id=_S, timestamp=_S, event_type=_S, source_ip=_S, user=_S,
    severity=_S, score=_I, status=_S, message=_S,
)

# Processing states.
STATUSES = ["pending", "normalized", "scored", "explained", "resolved"]
