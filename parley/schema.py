"""The canonical schema of a conversational corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string,loss:double>>"
PAIR_MESSAGES = "array<array<struct<role:string,content:string>>>"
MEDIA = "array<struct<bytes:binary,path:string>>"
OBJECTS = "struct<ref:array<string>,bbox:array<array<double>>,bbox_type:string,image_id:array<bigint>>"
ROLES = ("system", "user", "tool_call", "tool_response", "tool", "assistant")

_PAIR = {"messages": MESSAGES, "images": MEDIA, "videos": "array<string>", "audios": "array<string>", "tools": "string", "objects": OBJECTS}
#: Standard columns in order, with their types; None: the type depends on the task.
STANDARD: dict[str, str | None] = (
    _PAIR
    | {f"rejected_{k}": v for k, v in _PAIR.items()}
    | {f"{p}_{k}": PAIR_MESSAGES if k == "messages" else f"array<{v}>" for p in ("positive", "negative") for k, v in _PAIR.items()}
    | {"rejected_response": "string", "label": None, "channel": "string", "margin": "double", "teacher_prompt": "string"}
)


def prune(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The standard columns that df has, in standard order, and extra ones."""
    return df.select(*[c for c in (*STANDARD, *extra) if c in df.columns])


def conform(df: DataFrame) -> DataFrame:
    """Standard columns cast to their canonical types; others stay."""
    return df.select(*[F.col(c).cast(STANDARD[c]).alias(c) if STANDARD.get(c) else F.col(c) for c in df.columns])
