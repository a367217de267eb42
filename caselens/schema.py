"""Case record: 19 text fields and 12 multi-value fields, never NULL."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and their order are the catalogue's file format.
CORE_FIELDS = (
    "case_id", "title", "summary", "nature_judgment", "judgment_reason", "entry_channels",
    "impersonated_identity", "false_belief", "key_methods", "target_assets", "fraud_stage",
    "risk_signals", "risk_level", "loss_occurred", "loss_type", "prevention_advice",
    "source_name", "source_type", "collection_date", "is_desensitized", "official_category",
    "ccl2023_category", "custom_subcategory", "tags", "involved_platforms", "victim_group",
    "emergency_plan_id", "law_basis_ids", "source_links", "publish_date", "remark",
)
MULTI_VALUE_FIELDS = frozenset({
    "entry_channels", "impersonated_identity", "false_belief", "key_methods", "target_assets",
    "fraud_stage", "loss_type", "official_category", "tags", "involved_platforms",
    "law_basis_ids", "source_links",
})
REQUIRED_FIELDS = (
    "case_id", "judgment_reason", "prevention_advice", "risk_level", "risk_signals",
    "source_name", "summary", "title",
)
RISK_ORDER = {"极高": 0, "高": 1, "中": 2, "低": 3, "极低": 4}
NO_CATEGORY = "未分类"

TEXT = T.StringType()
TEXTS = T.ArrayType(T.StringType(), containsNull=True)

CASE_SCHEMA = T.StructType([
    T.StructField(name, TEXTS if name in MULTI_VALUE_FIELDS else TEXT) for name in CORE_FIELDS
])
CATEGORY_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("name", TEXT),
    T.StructField("item_count", T.LongType()),
])
PIECE_SCHEMA = T.StructType([
    T.StructField("sn", T.IntegerType()),
    T.StructField("pgs", TEXT),
    T.StructField("rg", T.ArrayType(T.IntegerType())),
    T.StructField("ls", T.BooleanType()),
    T.StructField("ws", T.ArrayType(T.StructType([
        T.StructField("cw", T.ArrayType(T.StructType([
            T.StructField("w", TEXT), T.StructField("lg", TEXT),
        ]))),
    ]))),
])
