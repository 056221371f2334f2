"""Prompt rendering: templates, weighted segments, thinking removal, truncation.

Texts are rendered as arrays of (text, weight, kind); lengths are in units of a tokenizer function, by default white-space
words.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import after_last, strip
from parley.operators.windows import last_user_round, runs

PIECES = "array<struct<text:string,weight:double,kind:string>>"


@dataclass(frozen=True)
class Template:
    """Texts around turns. A {{SYSTEM}} in prefix makes it the system prefix as well."""

    name: str
    prefix: str = ""
    prompt: str = "{{QUERY}}"
    chat_sep: str | None = ""
    suffix: str = ""
    system_prefix: str | None = None
    default_system: str | None = None
    stop_words: tuple[str, ...] = ()
    thinking_prefix: str = "<think>\n\n</think>\n\n"
    history_prefix: str = ""
    extras: dict = field(default_factory=dict, compare=False)

    @property
    def with_system(self) -> str | None:
        return self.prefix if "{{SYSTEM}}" in self.prefix else self.system_prefix

    @property
    def without_system(self) -> str:
        return "" if "{{SYSTEM}}" in self.prefix else self.prefix


#: Public chat formats.
TEMPLATES = {
    t.name: t
    for t in (
        Template("plain"),
        Template("chatml", "", "<|im_start|>user\n{{QUERY}}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n", "<|im_end|>\n", "<|im_start|>system\n{{SYSTEM}}<|im_end|>\n", stop_words=("<|im_end|>",)),
        Template("chatml_default", "", "<|im_start|>user\n{{QUERY}}<|im_end|>\n<|im_start|>assistant\n", "<|im_end|>\n", "<|im_end|>\n", "<|im_start|>system\n{{SYSTEM}}<|im_end|>\n", "You are a helpful assistant.", ("<|im_end|>",)),
        Template("header", "<|begin_of_text|>", "<|start_header_id|>user<|end_header_id|>\n\n{{QUERY}}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|eot_id|>", "<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n{{SYSTEM}}<|eot_id|>", stop_words=("<|eot_id|>",)),
        Template("inst", "<s>[INST] ", "{{QUERY}} [/INST]", "</s><s>[INST] ", "</s>", "<s>[INST] <<SYS>>\n{{SYSTEM}}\n<</SYS>>\n\n", stop_words=("</s>",)),
    )
}


def register_template(template: Template, exist_ok: bool = False) -> None:
    if template.name in TEMPLATES and not exist_ok:
        raise ValueError(f"the template {template.name} exists")
    TEMPLATES[template.name] = template


def std_rounds(messages: Column) -> Column:
    """(query, response) rounds: a leading assistant turn gets an empty query, an odd end a null response."""
    lead = F.coalesce(F.get(messages, 0)["role"] == "assistant", F.lit(False))

    def pairs(turns: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.ceil(F.size(turns) / 2).cast("int") - 1), lambda i: F.struct(F.get(turns, 2 * i).alias("query"), F.get(turns, 2 * i + 1).alias("response")))

    contents = F.transform(messages, lambda m: m["content"])
    whole = F.when(lead, F.concat(F.array(F.lit("")), contents)).otherwise(contents)
    return F.transform(F.array(whole), lambda t: F.when(F.size(t) > 0, pairs(t)).otherwise(F.array().cast("array<struct<query:string,response:string>>")))[0]


def segments(template: Template, system: Column, messages: Column, base: str = "default", training: bool = True) -> Column:
    """The pieces of a conversation of alternating user and assistant turns. Weights: responses and the suffix 1 under
    `default`, of the last rounds only under `last_round`, everything 1 under `all`; a message's own loss overrides."""
    system = F.coalesce(system, F.lit(template.default_system)) if template.default_system else system
    head_system = F.replace(F.lit(template.with_system or ""), F.lit("{{SYSTEM}}"), system)
    head = F.when(system.isNotNull() & F.lit(template.with_system is not None), head_system).otherwise(F.lit(template.without_system))
    low = 1.0 if base == "all" else 0.0

    def piece(text: Column, weight, kind: str) -> Column:
        return F.struct(text.alias("text"), (weight if isinstance(weight, Column) else F.lit(float(weight))).alias("weight"), F.lit(kind).alias("kind"))

    def build(p: Column) -> Column:
        rounds, last, n = p["rounds"], p["last"], F.size(p["rounds"])

        def one(r: Column, i: Column) -> Column:
            prompt = F.replace(F.replace(F.replace(F.lit(template.prompt), F.lit("{{ROUND0}}"), i.cast("string")), F.lit("{{ROUND1}}"), (i + 1).cast("string")), F.lit("{{QUERY}}"), F.coalesce(r["query"], F.lit("")))
            own = F.get(p["loss"], 2 * i + p["lead"] * -1 + 1)
            trained = F.lit(1.0) if base != "last_round" else F.when(2 * i >= last, 1.0).otherwise(0.0)
            weight = F.coalesce(own, trained)
            close = F.when(i + 1 < n, F.lit(template.chat_sep or "")).otherwise(F.lit(template.suffix) if training else F.lit(""))
            ended = F.lit(False)
            for stop in template.stop_words:
                ended = ended | F.coalesce(F.endswith(r["response"], F.lit(stop)), F.lit(False))
            answer = F.when(r["response"].isNotNull(), F.array(piece(r["response"], weight, "response"), F.when((i + 1 == n) & ended, piece(F.lit(""), 0.0, "suffix")).otherwise(piece(close, F.when(i + 1 < n, F.lit(low)).otherwise(weight), "suffix"))))
            return F.concat(F.array(piece(prompt, low, "other")), F.coalesce(answer, F.array().cast(PIECES)))

        return F.filter(F.concat(F.array(piece(head, low, "other")), F.flatten(F.transform(rounds, one))), lambda x: x["text"] != "")

    lead = F.coalesce((F.get(messages, 0)["role"] == "assistant").cast("int"), F.lit(0))
    losses = F.transform(messages, lambda m: m["loss"])
    return F.transform(F.array(F.struct(std_rounds(messages).alias("rounds"), (last_user_round(messages) + lead).alias("last"), losses.alias("loss"), lead.alias("lead"))), build)[0]


def text_of(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


def merge_segments(pieces: Column) -> Column:
    """Neighbours of equal weight as one piece."""

    def add(acc: Column, p: Column) -> Column:
        last = F.element_at(acc, -1)
        same = F.coalesce((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["weight"] == p["weight"]), F.lit(False))
        return F.when(same, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(last.withField("text", F.concat(last["text"], p["text"]))))).otherwise(F.concat(acc, F.array(p)))

    return F.aggregate(pieces, F.array().cast(PIECES), add)


def merge_same_role(turns: DataFrame, by: list[str], order: str, role: str = "role", content: str = "content") -> DataFrame:
    """Consecutive turns of one role as one, contents joined. A table of turns: gaps and islands."""
    d = runs(turns, role, by, order)
    merged = d.groupBy(*by, "run", role).agg(F.array_sort(F.collect_list(F.struct(order, content))).alias("_t"))
    return merged.select(*by, (F.col("run") - 1).alias("run"), role, F.array_join(F.transform("_t", lambda t: t[content]), "").alias(content))


def strip_thinking(content: Column, prefix: str = "") -> Column:
    """What follows the last </think>, stripped."""
    return F.when(F.contains(content, F.lit("</think>")), F.concat(F.lit(prefix), strip(after_last(content, "</think>")))).otherwise(content)


def remove_history_thinking(messages: Column, prefix: str = "") -> Column:
    """strip_thinking on assistant turns before the last user turn."""
    last = last_user_round(messages)
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & (i < last), m.withField("content", strip_thinking(m["content"], prefix))).otherwise(m))


def add_thinking_prefix(messages: Column, prefix: str, training: bool = True) -> Column:
    """The prefix before assistant turns that don't begin with <think>: all in training, else those of the last round."""
    last = last_user_round(messages)
    here = lambda i: F.lit(True) if training else i > last
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & here(i) & ~F.startswith(m["content"], F.lit("<think>")), m.withField("content", F.concat(F.lit(prefix), m["content"]))).otherwise(m))


def default_tags(content: Column, n: Column, tag: str) -> Column:
    """Tags put in front where the text has fewer than there are media."""
    return F.concat(F.repeat(F.lit(tag), F.greatest(n - F.regexp_count(content, F.lit(re.escape(tag))), F.lit(0))), content)


def image_paths(content: Column) -> Column:
    """struct(content, paths): <img>path</img> as <image> tags."""
    return F.struct(F.regexp_replace(content, r"(?s)<img>.+?</img>", "<image>").alias("content"), F.regexp_extract_all(content, F.lit(r"(?s)<img>(.+?)</img>"), 1).alias("paths"))


def scale_boxes(boxes: Column, width: Column, height: Column, kind: str = "real", to: int = 1000) -> Column:
    """Box coordinates in whole thousandths of the image, rounded half to even; norm1 coordinates are shares already."""
    def one(v: Column, i: Column) -> Column:
        side = F.when(i % 2 == 0, width).otherwise(height)
        return F.bround(v * to if kind == "norm1" else v / side * to, 0).cast("int")

    return F.transform(boxes, lambda b: F.transform(b, one))


def replace_in_order(text: Column, tag: str, values: Column) -> Column:
    """The i-th tag becomes the i-th value; tags beyond the values stay."""
    parts = F.split(text, re.escape(tag), -1)
    return F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.coalesce(F.get(values, i - 1), F.lit(tag)), p))), "")


def box_text(box: Column) -> Column:
    """[(x1,y1),(x2,y2)]"""
    points = F.transform(F.sequence(F.lit(0), F.floor(F.size(box) / 2).cast("int") - 1), lambda i: F.concat(F.lit("("), F.get(box, 2 * i).cast("string"), F.lit(","), F.get(box, 2 * i + 1).cast("string"), F.lit(")")))
    return F.concat(F.lit("["), F.array_join(points, ","), F.lit("]"))


def truncate(ids: Column, most: int, side: str = "right") -> Column:
    return F.slice(ids, 1, most) if side == "right" else F.when(F.size(ids) > most, F.slice(ids, F.size(ids) - most + 1, most)).otherwise(ids)


def split_windows(ids: Column, most: int) -> Column:
    """Windows of at most `most` in order; none for an empty array."""
    return F.when(F.size(ids) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(ids) - 1) / most).cast("int")), lambda i: F.slice(ids, i * most + 1, most))).otherwise(F.array().cast("array<array<string>>"))


def masked_labels(ids: Column, weights: Column, ignore: int = -100) -> Column:
    """ids where the weight is positive, else ignore; the first one always ignored."""
    return F.zip_with(F.zip_with(ids, weights, lambda x, w: F.when(w > 0, x).otherwise(ignore)), F.sequence(F.lit(0), F.size(ids) - 1), lambda x, i: F.when(i == 0, ignore).otherwise(x))


def find_sublists(ids: Column, part: Column) -> Column:
    """Start of every occurrence of part."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(ids) - F.size(part), F.lit(0)))
    return F.filter(starts, lambda i: F.slice(ids, i + 1, F.size(part)) == part)


def pixel_limit(width: Column, height: Column, most: int) -> Column:
    """struct(width, height) scaled down to at most `most` pixels, the ratio kept."""
    ratio = width / height
    h = F.sqrt(most / ratio)
    small = width * height <= most
    return F.struct(F.when(small, width).otherwise(F.floor(h * ratio)).cast("int").alias("width"), F.when(small, height).otherwise(F.floor(h)).cast("int").alias("height"))


# ---------------------------------------------------------------- loss weights


def parse_strategy(name: str) -> tuple[str, str | None]:
    """(base, map) of 'base+map', either part optional."""
    bases = ("default", "last_round", "all")
    parts = name.split("+")
    if len(parts) == 1:
        return (parts[0], None) if parts[0] in bases else ("default", parts[0])
    if len(parts) != 2 or parts[0] not in bases:
        raise ValueError(f"unknown strategy {name}")
    return parts[0], parts[1]


#: Weights of responses by strategy, as delimiters with weights of the key and of what follows, or as patterns
#: with one weight. Entries of other lengths are no delimiters.
WEIGHT_MAPS: dict[str, dict[str, list[float]]] = {
    "react": {"Action:": [2.0, 2.0], "Action Input:": [2.0, 2.0], "Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0]},
    "hermes": {r"<tool_call>.+?</tool_call>": [2.0]},
    "qwen": {"✿FUNCTION✿:": [2.0, 2.0], "✿ARGS✿:": [2.0, 2.0], "✿RETURN✿:": [1.0, 1.0], "✿RESULT✿:": [2.0, 0.0]},
    "ignore_empty_think": {
        r"^<think>\s*</think>\s*": [0.0],
        r"^<seed:think><seed:cot_budget_reflect>The current thinking budget is 0, so I will directly start answering the question.</seed:cot_budget_reflect>\n</seed:think>\s*": [0.0],
        r"^</think>\s*": [0.0],
    },
    "alpha_umi": {"Action:": [2.0, 2.0], "Action Input:": [2.0, 2.0], "Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0], "Next:": [2, 0, 2.0]},
    "agentflan": {
        "Name:": [1.0, 3.0], "Action:": [1.0, 3.0], "ACTION:": [1.0, 3.0], "Tool:": [1.0, 3.0], "Command": [1.0, 3.0], "Arguments:": [1.0, 3.0],
        "action input": [1.0, 3.0], "ACTION_INPUT:": [1.0, 3.0], "Action Input:": [1.0, 3.0], "Thought:": [1.0, 1.0], "Final Answer:": [1.0, 1.0], "Observation:": [2.0, 0.0],
    },
}
#: The weight of a whole response where the query has one of these texts.
QUERY_WEIGHTS: dict[str, dict[str, float]] = {
    "agentflan": {"What is the tool you want to use": 3.0, "What are the required parameter names": 3.0, "What is the value of": 3.0, "What are the required parameter names for this tool": 3.0},
}


def is_binary(weights: dict[str, list[float]]) -> bool:
    return all(w in (0, 1, 0.0, 1.0) for ws in weights.values() for w in ws)


def split_parts(text: str, delimiters: list[str], regex: bool = False) -> list[tuple[str, str]]:
    """[(key, content)] of a text cut at delimiters; what leads has the key ''. With regex, delimiters are patterns, and a
    match is a key of its own, named by the first pattern that it matches from its start."""
    if not delimiters:
        return [("", text)]
    every = "|".join(f"(?:{d})" if regex else re.escape(d) for d in sorted(delimiters, key=len, reverse=True) if d) if not regex else "|".join(f"(?:{d})" for d in delimiters)
    out, at, key = [], 0, ""
    for m in re.finditer(every, text, re.S):
        if m.start() > at or key:
            out.append((key, text[at : m.start()]))
        if regex:
            out.append((next(d for d in delimiters if re.match(d, m[0], re.S)), m[0]))
            key, at = "", m.end()
        else:
            key, at = m[0], m.end()
    if at < len(text) or key:
        out.append((key, text[at:]))
    return out


def weighted_parts(text: str, weights: dict[str, list[float]]) -> list[tuple[str, float]]:
    """A response as (text, weight): keys and contents of two-weight delimiters, or whole matches of one-weight patterns."""
    two = [k for k, w in weights.items() if len(w) == 2]
    one = [k for k, w in weights.items() if len(w) == 1]
    out: list[tuple[str, float]] = []
    if two:
        for key, content in split_parts(text, two):
            if key:
                out += [(key, float(weights[key][0])), (content, float(weights[key][1]))]
            else:
                out.append((content, 1.0))
    else:
        out = [(content, float(weights[key][0]) if key else 1.0) for key, content in split_parts(text, one, True)]
    return [(t, w) for t, w in out if t]


def response_weights(content: Column, weights: dict[str, list[float]], query: Column | None = None, by_query: dict[str, float] | None = None) -> Column:
    """array<struct<text, weight>> of a response; one of whose query has a text of by_query is one piece of that weight."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("weight", T.DoubleType())])))
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[{"text": t, "weight": w} for t, w in weighted_parts(x or "", weights)] for x in s])

    out = run(content)
    if query is None or not by_query:
        return out
    hit = F.coalesce(*[F.when(F.contains(query, F.lit(k)), F.lit(float(w))) for k, w in by_query.items()])
    return F.when(hit.isNotNull(), F.array(F.struct(content.alias("text"), hit.alias("weight")))).otherwise(out)


def encoded_length(ids: Column, labels: Column) -> Column:
    """The longer of ids and labels; null arrays count as empty."""
    return F.greatest(F.coalesce(F.size(ids), F.lit(0)), F.coalesce(F.size(labels), F.lit(0)), F.lit(0))


# ---------------------------------------------------------------- token arrays


def end_tokens(ids: Column, labels: Column, suffix: list[int], ignore: int = -100) -> Column:
    """Labels with the suffix's ids unmasked where it directly follows a supervised token."""
    n = len(suffix)
    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(ids) - n, F.lit(1))), lambda i: (i + n <= F.size(ids)) & (F.slice(ids, i + 1, n) == F.array(*map(F.lit, suffix))) & (F.get(labels, i - 1) != ignore))
    return F.transform(labels, lambda y, i: F.when(F.exists(starts, lambda s: (i >= s) & (i < s + n)), F.get(ids, i)).otherwise(y))


def extend_tokens(ids: Column, labels: Column, token: int, by: Column, ignore: int = -100) -> Column:
    """struct(ids, labels): each occurrence of a token becomes the array `by`, with ignored labels."""
    pairs = F.zip_with(ids, labels, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    return F.struct(
        F.flatten(F.transform(pairs, lambda p: F.when(p["x"] == token, by).otherwise(F.array(p["x"])))).alias("ids"),
        F.flatten(F.transform(pairs, lambda p: F.when(p["x"] == token, F.transform(by, lambda b: F.lit(ignore))).otherwise(F.array(p["y"])))).alias("labels"),
    )


def replace_responses(messages: Column, responses: Column) -> Column:
    """Assistant turns take the responses from the last one backwards; earlier turns stay where responses run out."""
    later = lambda i: F.size(F.filter(F.slice(messages, i + 2, F.greatest(F.size(messages) - i - 1, F.lit(0))), lambda m: m["role"] == "assistant"))
    return F.transform(messages, lambda m, i: F.when((m["role"] == "assistant") & (later(i) < F.size(responses)), m.withField("content", F.get(responses, F.size(responses) - 1 - later(i)))).otherwise(m))


def decode_classes(logits: Column, multi: bool = False) -> Column:
    """The best class, or the classes whose sigmoid is a half or more."""
    if multi:
        return F.filter(F.transform(logits, lambda x, i: F.when(x >= 0, i).otherwise(-1)), lambda i: i >= 0)
    return F.array_position(logits, F.array_max(logits)).cast("int") - 1


def top_logprobs(logits: Column, k: int) -> Column:
    """The k best classes as (class, logprob), best first."""
    def score(x: Column) -> Column:
        top = F.array_max(x)
        z = top + F.ln(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top)))
        rows = F.transform(x, lambda v, i: F.struct((z - v).alias("cost"), i.alias("cls")))
        return F.transform(F.slice(F.array_sort(rows), 1, k), lambda p: F.struct(p["cls"].alias("cls"), (-p["cost"]).alias("logprob")))

    return F.transform(F.array(logits), score)[0]
