"""Row layouts to the canonical one: renames, casts, message building."""

from __future__ import annotations

import ast
import json
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from parley.functions.text import truthy
from parley.schema import MEDIA, MESSAGES, OBJECTS, prune

#: Column synonyms, in order of preference, and synonyms of keys and roles in messages.
SYNONYMS = {
    "system": ("system", "system_prompt"),
    "query": ("query", "prompt", "input", "instruction", "question", "problem"),
    "response": ("response", "answer", "output", "targets", "target", "answer_key", "answers", "solution", "text", "completion", "content"),
}
ROLE_KEYS, CONTENT_KEYS, MESSAGE_COLUMNS = ("role", "from"), ("content", "value"), ("messages", "conversation", "conversations")
ROLE_NAMES = {"user": ("user", "human"), "assistant": ("assistant", "gpt", "bot"), "tool_call": ("function_call",), "tool_response": ("function_response", "observation", "observations")}


def safe_rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Renames without regard to case. Targets that two present columns map to stay unassigned; a column that already has
    its target's name counts as one of them."""
    low = {k.lower(): v for k, v in columns.items()}
    present = {c: low[c.lower()] for c in df.columns if c.lower() in low}
    counts: dict[str, int] = {}
    for target in present.values():
        counts[target] = counts.get(target, 0) + 1
    return df.withColumnsRenamed({c: t for c, t in present.items() if counts[t] == 1 and c != t})


def synonym_map(keep: tuple[str, ...] = ()) -> dict[str, str]:
    return {name: target for target, names in SYNONYMS.items() for name in names if name not in keep}


def rename_both(df: DataFrame, columns: dict[str, str] | None = None, synonyms: dict[str, str] | None = None) -> DataFrame:
    """The user's renames, then the built-in synonyms; solution is kept under its own name beside its use as response."""
    df = safe_rename(df, columns or {})
    kept = "solution" in df.columns
    if kept:
        df = df.withColumn("__solution", F.col("solution"))
    df = safe_rename(df, synonym_map() if synonyms is None else synonyms)
    return df.withColumnRenamed("__solution", "solution") if kept and "solution" not in df.columns else df.drop("__solution")


def cast_media(df: DataFrame) -> DataFrame:
    """Images as [{bytes, path}] and videos and audios as [path], from a text, a list of texts, a struct or a list."""
    out = df
    for name in df.columns:
        kind, c = df.schema[name].dataType, F.col(name)
        if name in ("images", "rejected_images"):
            if isinstance(kind, T.StringType):
                c = F.array(F.struct(F.lit(None).cast("binary").alias("bytes"), c.alias("path")))
            elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
                c = F.transform(c, lambda x: F.struct(F.lit(None).cast("binary").alias("bytes"), x.alias("path")))
            elif isinstance(kind, T.StructType):
                c = F.array(c)
            out = out.withColumn(name, F.when(F.col(name).isNotNull(), c.cast(MEDIA)))
        elif name in ("videos", "audios") and isinstance(kind, T.StringType):
            out = out.withColumn(name, F.when(c.isNotNull(), F.array(c)))
    return out


def normalize_objects(objects: Column) -> Column:
    """Key order, and boxes of four numbers as (min, min, max, max); a box of neither two nor four numbers raises."""

    def box(b: Column) -> Column:
        four = F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3]))
        return F.when(F.size(b) == 4, four).when(F.size(b) == 2, b).otherwise(F.raise_error(F.lit("a box has two or four numbers")).cast("array<double>"))

    made = F.struct(objects["ref"].alias("ref"), F.transform(objects["bbox"], box).alias("bbox"), objects["bbox_type"].alias("bbox_type"), objects["image_id"].alias("image_id"))
    return F.when(objects.isNotNull(), made.cast(OBJECTS))


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), F.lit(None).cast("double").alias("loss"))


def present(messages: Column) -> Column:
    """Messages whose content isn't null."""
    return F.filter(messages, lambda m: m["content"].isNotNull())


def history_to_messages(history: Column, system: Column | None = None) -> Column:
    """[[query, response], ...] as messages; null turns are left out."""
    turns = F.flatten(F.transform(history, lambda h: F.array(message("user", F.get(h, 0)), message("assistant", F.get(h, 1)))))
    return present(turns if system is None else F.concat(F.array(message("system", system)), turns))


def messages_to_history(messages: Column) -> Column:
    """struct(system, history, query, response): pairs of contents, an odd end padded with null; the last is query and
    response."""
    def split(parts: Column) -> Column:
        turns, system = parts["turns"], parts["system"]
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(turns) / 2).cast("int") - 1, F.lit(0))), lambda i: F.array(F.get(turns, 2 * i)["content"], F.get(turns, 2 * i + 1)["content"]))
        last = F.element_at(pairs, -1)
        return F.struct(system.alias("system"), F.slice(pairs, 1, F.size(pairs) - 1).alias("history"), last[0].alias("query"), last[1].alias("response"))

    head = F.get(messages, 0)
    leads = F.coalesce(head["role"] == "system", F.lit(False))
    parts = F.struct(F.when(leads, head["content"]).alias("system"), F.when(leads, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages).alias("turns"))
    return F.transform(F.array(parts), split)[0]


def read_history(text: str | None) -> list[list[str | None]] | None:
    if not text:
        return None
    for read in (json.loads, ast.literal_eval):
        try:
            return [[None if x is None else str(x) for x in pair] for pair in read(text)]
        except (ValueError, SyntaxError, TypeError):
            continue
    return None


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def parse_history(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A history written as JSON or as a Python literal; the fallback for rows that from_json can't read."""
    for s in parts:
        yield pd.Series([read_history(x) for x in s], dtype=object)


def query_response(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """messages from system, history, query and response. A list response gives its first element; null turns are left
    out."""
    df = rename_both(df, columns)
    kinds = dict(df.dtypes)

    def value(name: str) -> Column:
        if name not in kinds:
            return F.lit(None).cast("string")
        return (F.get(name, 0) if kinds[name].startswith("array") else F.col(name)).cast("string")

    parts = [F.array(message("system", value("system")))]
    if "history" in kinds:
        history = F.col("history")
        if kinds["history"] == "string":
            history = F.coalesce(F.from_json(history, "array<array<string>>"), F.when(F.length(history) > 0, parse_history(history)))
        parts.append(F.coalesce(history_to_messages(history), F.array().cast(MESSAGES)))
    parts.append(F.array(message("user", value("query")), message("assistant", value("response"))))
    return df.withColumn("messages", present(F.concat(*parts))).drop("system", "history", "query", "response")


def alpaca(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """instruction and input joined by a newline where both are there, whichever is otherwise; then query_response."""
    df = safe_rename(df, columns or {})
    a, b = F.col("instruction").cast("string"), F.col("input").cast("string") if "input" in df.columns else F.lit(None).cast("string")
    both = F.when(truthy(a) & truthy(b), F.concat(a, F.lit("\n"), b)).when(truthy(a), a).otherwise(b)
    d = df.withColumn("query", both).drop("instruction", "input")
    return query_response(d.withColumnRenamed("output", "response") if "output" in d.columns else d)


def role_name(role: Column, names: dict[str, tuple[str, ...]] = ROLE_NAMES) -> Column:
    """Canonical role; - counts as _."""
    plain = F.replace(role, F.lit("-"), F.lit("_"))
    return reduce(lambda c, kv: F.when(plain.isin(*kv[1]), kv[0]).otherwise(c), names.items(), plain)


def build_messages(df: DataFrame, column: str, role_key: str | None = None, content_key: str | None = None, inner_key: str | None = None) -> Column:
    """Canonical messages from an array of {role, content}, {from, value} or {human, assistant} structs or maps; an empty
    array gives null, which drops the row."""
    kind, c = df.schema[column].dataType, F.col(column)
    if inner_key:
        c, kind = c[inner_key], kind[inner_key].dataType
    if isinstance(kind, T.StringType):
        c = F.from_json(c, "array<struct<role:string,content:string,loss:double,from:string,value:string,human:string,user:string,assistant:string,gpt:string,bot:string>>")
        keys = ["role", "content", "loss", "from", "value", "human", "user", "assistant", "gpt", "bot"]
    else:
        keys = list(kind.elementType.names) if isinstance(kind.elementType, T.StructType) else ["role", "content"]
    roles = [k for k in ((role_key,) if role_key else ROLE_KEYS) if k in keys]
    contents = [k for k in ((content_key,) if content_key else CONTENT_KEYS) if k in keys]
    users, bots = [k for k in ROLE_NAMES["user"] if k in keys], [k for k in ROLE_NAMES["assistant"] if k in keys]

    def pick(m: Column, names: list[str]) -> Column:
        return F.coalesce(*[m[k].cast("string") for k in names]) if names else F.lit(None).cast("string")

    loss = (lambda m: m["loss"].cast("double")) if "loss" in keys else (lambda m: F.lit(None).cast("double"))
    plain = F.transform(c, lambda m: F.struct(role_name(pick(m, roles)).alias("role"), pick(m, contents).alias("content"), loss(m).alias("loss")))
    if users and bots:
        pairs = present(F.flatten(F.transform(c, lambda m: F.array(message("user", pick(m, users)), message("assistant", pick(m, bots))))))
        first = F.get(c, 0)
        plain = F.when(pick(first, roles).isNull() & pick(first, contents).isNull(), pairs).otherwise(plain) if roles or contents else pairs
    return F.when(F.size(c) > 0, plain.cast(MESSAGES))


def messages_layout(df: DataFrame, columns: dict[str, str] | None = None, **keys) -> DataFrame:
    """Message arrays of any spelling; a system column leads where the first role isn't system. Rows without messages go."""
    df = safe_rename(df, columns or {})
    df = safe_rename(df, {k: "messages" for k in MESSAGE_COLUMNS} | {"system_prompt": "system"})
    made = build_messages(df, "messages", **keys)
    if "system" in df.columns:
        system = F.col("system").cast("string")
        made = F.when(system.isNotNull() & (F.get(made, 0)["role"] != "system"), F.concat(F.array(message("system", system)), made)).otherwise(made)
    d = df.withColumn("messages", made)
    if "rejected_messages" in df.columns:
        d = d.withColumn("rejected_messages", build_messages(df, "rejected_messages", **keys))
    return d.where("messages IS NOT NULL").drop("system")


def classification(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """query_response with label as a whole number; labels that aren't drop the row."""
    return query_response(df, columns).withColumn("label", F.expr("try_cast(label AS bigint)")).where("label IS NOT NULL")


def auto(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """The layout by the columns there are: message arrays, instruction and input, or query and response."""
    low = {c.lower() for c in safe_rename(df, columns or {}).columns}
    if low & set(MESSAGE_COLUMNS):
        return messages_layout(df, columns)
    return alpaca(df, columns) if {"instruction", "input"} <= low else query_response(df, columns)


def text_generation(df: DataFrame, prompt: str, tag: str = "{{QUERY}}", columns: dict[str, str] | None = None) -> DataFrame:
    d = rename_both(df, columns)
    return query_response(d.withColumn("query", F.replace(F.lit(prompt), F.lit(tag), F.col("query"))))


def classification_as_generation(df: DataFrame, labels: list[str], task: str, pair: bool = False) -> DataFrame:
    """Task, sentence, categories and output as a prompt; the response is the label's name. Rows without label go."""
    if pair:
        inputs = F.concat(F.lit("Sentence1: "), F.col("sentence1"), F.lit("\nSentence2: "), F.col("sentence2"))
    else:
        inputs = F.concat(F.lit("Sentence: "), F.col("sentence"))
    prompt = F.concat(F.lit(f"Task: {task}\n"), inputs, F.lit(f"\nCategory: {', '.join(labels)}\nOutput:"))
    d = df.where("label IS NOT NULL").withColumn("query", prompt)
    return query_response(d.withColumn("response", F.element_at(F.array(*map(F.lit, labels)), F.col("label").cast("int") + 1)).select("query", "response"))


def remove_response(messages: Column) -> Column:
    """struct(messages, label): a trailing assistant turn is taken off and given as the label."""
    last = F.element_at(messages, -1)
    ends = F.coalesce((F.size(messages) > 0) & (F.try_element_at(messages, F.lit(-1))["role"] == "assistant"), F.lit(False))
    return F.struct(F.when(ends, F.slice(messages, 1, F.size(messages) - 1)).otherwise(messages).alias("messages"), F.when(ends, last["content"]).alias("label"))


def teacher_messages(messages: Column, prompt: Column) -> Column:
    """Without a trailing assistant turn, and the last user turn's content replaced."""
    from parley.operators.windows import last_user_round

    bare = remove_response(messages)["messages"]
    return F.when(prompt.isNull(), messages).otherwise(F.transform(bare, lambda m, i: F.when(i == last_user_round(bare), m.withField("content", prompt)).otherwise(m)))


def rejected_messages(messages: Column, response: Column) -> Column:
    """The messages up to the last user turn, and the rejected response."""
    from parley.operators.windows import last_user_round

    return F.concat(F.slice(messages, 1, last_user_round(messages) + 1), F.array(message("assistant", response))).cast(MESSAGES)


def split_system(messages: Column) -> Column:
    """struct(system, messages): a leading system turn apart, and tool_response as tool."""
    head = F.get(messages, 0)
    leads = F.coalesce(head["role"] == "system", F.lit(False))
    rest = F.when(leads, F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0)))).otherwise(messages)
    return F.struct(F.when(leads, head["content"]).alias("system"), F.transform(rest, lambda m: m.withField("role", F.when(m["role"] == "tool_response", "tool").otherwise(m["role"]))).alias("messages"))


def inherit_rejected(df: DataFrame) -> DataFrame:
    """Missing rejected_* columns take the chosen ones, unless rejected_messages was given."""
    names = [c for c in ("images", "videos", "audios", "tools", "objects") if c in df.columns]
    for c in names:
        own = F.col(f"rejected_{c}") if f"rejected_{c}" in df.columns else F.lit(None)
        df = df.withColumn(f"rejected_{c}", F.coalesce(own, F.col(c)))
    return df


def flatten_parts(parts: Column) -> Column:
    """Content parts {type, text} as one text with tags for media."""
    return F.array_join(F.transform(parts, lambda p: F.when(p["type"] == "text", F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("<"), F.replace(p["type"], F.lit("_url"), F.lit("")), F.lit(">")))), "")


def canonical(df: DataFrame) -> DataFrame:
    return prune(cast_media(df))


def literal_frame(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Python literals or JSON as JSON text, null where neither reads."""
    for s in parts:
        out = []
        for x in s:
            for read in (json.loads, ast.literal_eval):
                try:
                    out.append(json.dumps(read(x), ensure_ascii=False))
                    break
                except (ValueError, SyntaxError, TypeError):
                    continue
            else:
                out.append(None)
        yield pd.Series(out, dtype=object)


literal_json = F.pandas_udf(literal_frame, T.StringType())


def parallel_inputs(lists: Column, names: list[str]) -> Column:
    """A struct of parallel lists as a list of structs, the i-th of the i-th elements; shorter lists end in nulls."""
    return F.arrays_zip(*[lists[n].alias(n) for n in names])


def columns_to_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each place of a row's parallel arrays, padded with nulls to the longest."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.arrays_zip(*[F.col(c).alias(c) for c in columns])))


def rows_to_columns(df: DataFrame, by: list[str], order: str, columns: list[str]) -> DataFrame:
    """Arrays of a group's values in order; nulls keep their places."""
    rows = F.array_sort(F.collect_list(F.struct(order, *columns)))
    return df.groupBy(*by).agg(rows.alias("_r")).select(*by, *[F.col("_r").getField(c).alias(c) for c in columns])


def map_rows(df: DataFrame, function: Callable[[dict], dict | list[dict] | None], schema: str | T.StructType, strict: bool = True) -> DataFrame:
    """A row function that gives no row, one or several for each row. Unless strict, rows that it fails on go. Rows travel in
    Arrow batches."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                try:
                    made = function(row)
                except Exception:
                    if strict:
                        raise
                    continue
                out += [] if made is None else made if isinstance(made, list) else [made]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return df.mapInArrow(run, kind)


def preprocess(df: DataFrame, layout: Callable[[DataFrame], DataFrame], columns: dict[str, str] | None = None, sample: int | None = None, key: str | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None, seed: int = 42, remove_unused: bool = True) -> DataFrame:
    """The steps that every preprocessor shares: an exact sample first, renames, a hook on the whole table, the layout, and
    the canonical columns only."""
    from parley.operators.ordering import sample as exact_sample

    if sample is not None:
        df = exact_sample(df, sample, key, seed).drop("copy")
    df = safe_rename(df, columns or {})
    made = cast_media(layout(prepare(df) if prepare else df))
    return prune(made, (key,) if key else ()) if remove_unused else made
