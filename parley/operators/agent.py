"""Tool-call formats: extraction of calls from responses, and rendering of calls and results. Tool lists are in tools.py.

Each format is a parser from text to [(name, arguments)] and a renderer. A format whose own parser finds nothing falls
back to Action / Action Input pairs, except where noted.
"""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Calls = list[tuple[str, str]]
CALLS = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType())]))


def parse_value(text: str):
    """JSON, else a Python literal, else None."""
    for read in (json.loads, ast.literal_eval):
        try:
            return read(text)
        except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
            continue
    return None


def dump(value) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def react_calls(text: str) -> Calls:
    found = re.findall(r"Action:(.*?)Action Input:(.*?)(?=Observation:|Action:|\Z)", text, re.S)
    return [(a.strip(), b.strip()) for a, b in found]


def json_calls(pattern: str, arguments: str = "arguments") -> Callable[[str], Calls]:
    """Calls as JSON objects in the first group of a pattern."""

    def parse(text: str) -> Calls:
        out = []
        for body in re.findall(pattern, text, re.S):
            value = parse_value(body)
            for item in value if isinstance(value, list) else [value]:
                if isinstance(item, dict) and "name" in item and arguments in item:
                    out.append((str(item["name"]), dump(item[arguments])))
        return out

    return parse


def object_calls(text: str) -> Calls:
    """Calls as bare objects of name and parameters anywhere in a text; other objects are searched for calls within."""
    decoder, out, at = json.JSONDecoder(), [], text.find("{")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except (ValueError, RecursionError):
            value, end = None, at + 1
        if isinstance(value, dict) and "name" in value and "parameters" in value:
            out.append((str(value["name"]), dump(value["parameters"])))
        else:
            end = at + 1
        at = text.find("{", end)
    return out


def fenced_calls(text: str) -> Calls:
    """A name and a fenced JSON body in each <tool_call>; without any, JSON objects there."""
    found = re.findall(r"<tool_call>([^`]+?)\s*```json(.+?)```\s*</tool_call>", text, re.S)
    return [(n.strip(), dump(parse_value(a))) for n, a in found] or json_calls(r"<tool_call>(.+?)</tool_call>")(text)


def xml_calls(block: str, name: str, parameter: str, convert: bool, strip: bool = True) -> Callable[[str], Calls]:
    """Calls as a named block of named parameters; values as texts, or as JSON where they parse."""

    def parse(text: str) -> Calls:
        out = []
        for body in re.findall(block, text, re.S):
            for n, inside in re.findall(name, body, re.S):
                args = {k.strip(): v.strip() if strip else v for k, v in re.findall(parameter, inside, re.S)}
                if convert:
                    args = {k: v if (p := parse_value(v)) is None else p for k, v in args.items()}
                out.append((n.strip(), json.dumps(args, ensure_ascii=False)))
        return out

    return parse


def key_value_calls(text: str) -> Calls:
    """<tool_call>name and pairs of <arg_key> and <arg_value>; unequal numbers make it no call."""
    out = []
    for body in re.findall(r"<tool_call>(.*?)</tool_call>", text, re.S):
        keys, values = re.findall(r"<arg_key>(.*?)</arg_key>", body, re.S), re.findall(r"<arg_value>(.*?)</arg_value>", body, re.S)
        if len(keys) == len(values):
            out.append((body.split("<arg_key>")[0].strip(), json.dumps(dict(zip([k.strip() for k in keys], [v.strip() for v in values])), ensure_ascii=False)))
    return out


def name_line_calls(text: str) -> Calls:
    """A name on a line of its own, and a JSON body, once for each assistant part."""
    out = []
    for part in text.replace("<|observation|>", "").split("<|assistant|>"):
        m = re.search(r"\A\s*([\w.-]+)\n(\{.*\})", part, re.S)
        if m and parse_value(m[2]) is not None:
            out.append((m[1], m[2].strip()))
    return out


def separator_calls(text: str) -> Calls:
    """Name, separator and arguments between call marks; arguments that don't parse leave the call out."""
    found = re.findall(r"<｜tool▁call▁begin｜>(.*?)<｜tool▁sep｜>(.*?)<｜tool▁call▁end｜>", text, re.S)
    return [(n.strip(), a.strip()) for n, a in found if parse_value(a.strip()) is not None]


def first_block_calls(text: str) -> Calls | None:
    """The first [TOOL_CALLS] block, one JSON value a line; None where there is no block."""
    m = re.search(r"\[TOOL_CALLS\]\s*\[(.*?)\]\s*</s>", text, re.S)
    if not m:
        return None
    whole = parse_value(f"[{m[1]}]")
    values = [whole] if whole is not None else [parse_value(f"[{line.strip().rstrip(',')}]") for line in m[1].splitlines()]
    items = [i for v in values if isinstance(v, list) for i in v]
    return [(str(i["name"]), dump(i["arguments"])) for i in items if isinstance(i, dict) and "name" in i and "arguments" in i]


@dataclass(frozen=True)
class ToolFormat:
    """How calls are read and written: `call` writes one of a name and a parsed value, `head` and `tail` stand around all of
    them; `result` writes one tool's answer, `answers` holds what stands before, between and after them."""

    name: str
    parse: Callable[[str], Calls | None]
    call: Callable[[str, object], str]
    result: Callable[[str], str]
    sep: str = "\n"
    head: str = ""
    tail: str = ""
    answers: tuple[str, str, str] = ("", "\n", "")
    fallback: bool = True

    def calls(self, text: str | None) -> Calls:
        found = self.parse(text or "")
        if found or not self.fallback or found is None:
            return found or []
        return react_calls(text or "")

    def render_calls(self, calls: Calls) -> str:
        """One text of all calls; arguments that are neither JSON nor a literal stand as they are."""
        return self.render_values([(n, a if (v := parse_value(a)) is None else v) for n, a in calls])

    def render_values(self, values: list[tuple[str, object]]) -> str:
        return self.head + self.sep.join(self.call(n, v) for n, v in values) + self.tail if values else ""

    def render_results(self, contents: list[str]) -> str:
        """One text of the tools' answers to one turn."""
        before, between, after = self.answers
        return before + between.join(self.result(c) for c in contents) + after


def _json_call(name: str, value, key: str = "arguments") -> str:
    return json.dumps({"name": name, key: value}, ensure_ascii=False)


def _nested(value) -> str:
    """JSON with escapes of lists and objects, the literal of other values."""
    return json.dumps(value) if isinstance(value, (dict, list)) else str(value)


def _xml(open_: str, parameter: str, close: str, text: Callable[[object], str] = dump, sep: str = "") -> Callable[[str, object], str]:
    def render(name: str, args) -> str:
        return open_.format(name=name) + sep.join(parameter.format(k=k, v=text(v)) for k, v in (args.items() if isinstance(args, dict) else ())) + close

    return render


def keyword_calls(action: str, given: str, stop: str) -> Callable[[str], Calls]:
    pattern = re.compile(f"{action}(.*?){given}(.*?)(?={stop}|\\Z)", re.S)
    return lambda text: [(n.strip(), a.strip()) for n, a in pattern.findall(text)]


def _line(text: str) -> str:
    return text if text.endswith("\n") else text + "\n"


def _formats() -> Iterator[ToolFormat]:
    json_block, json_text = json_calls(r"<tool_call>(.+?)</tool_call>"), lambda n, v: f"<tool_call>\n{_json_call(n, v)}\n</tool_call>"
    function, parameter = r"<function=([^>]+)>(.*?)</function>", r"<parameter=([^>]+)>(.*?)</parameter>"
    for name in ("react_en", "react_zh", "react_grpo", "toolbench"):
        yield ToolFormat(name, react_calls, lambda n, v: f"Action: {n}\nAction Input: {v}\n", _line, "", tail="Observation:", answers=("", "Observation:", ""))
    for name in ("qwen_en", "qwen_zh", "qwen_en_parallel", "qwen_zh_parallel"):
        yield ToolFormat(name, keyword_calls("✿FUNCTION✿:", "✿ARGS✿:", "✿"), lambda n, v: f"✿FUNCTION✿: {n}\n✿ARGS✿: {v}\n", _line, "", tail="✿RESULT✿:", answers=("", "✿RESULT✿:", ""))
    yield ToolFormat("hermes", json_block, json_text, lambda r: f"<tool_response>\n{r}\n</tool_response>")
    yield ToolFormat("hunyuan_hermes", fenced_calls, json_text, lambda r: f"<tool_response>{r}</tool_response>", head="<tool_calls>\n", tail="\n</tool_calls>", answers=("<tool_responses>", "\n", "</tool_responses>"))
    for name, start, end, stop in (("llama3", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>"), ("llama4", "<|header_start|>", "<|header_end|>", "<|eot|>")):
        yield ToolFormat(name, object_calls, lambda n, v: _json_call(n, v, "parameters"), lambda r, b=f"{start}tool{end}\n\n", e=stop: f"{b}{r}{e}", answers=(stop, "", f"{start}assistant{end}\n\n"))
    for name in ("chatglm4", "glm4"):
        yield ToolFormat(name, name_line_calls, lambda n, v: f"{n}\n{v}", lambda r: r, "<|assistant|>", tail="<|observation|>", answers=("\n", "<|observation|>\n", "<|assistant|>\n"))
    yield ToolFormat("glm4_5", key_value_calls, _xml("<tool_call>{name}\n", "<arg_key>{k}</arg_key>\n<arg_value>{v}</arg_value>\n", "</tool_call>", str), lambda r: f"\n<tool_response>\n{r}\n</tool_response>", tail="<|observation|>", answers=("", "", "<|assistant|>\n"))
    yield ToolFormat("glm4_7", key_value_calls, _xml("<tool_call>{name}", "<arg_key>{k}</arg_key><arg_value>{v}</arg_value>", "</tool_call>", str), lambda r: f"<tool_response>{r}</tool_response>", "", tail="<|observation|>", answers=("", "", "<|assistant|>"))
    coder = xml_calls(r"<tool_call>\s*(<function=.*?</function>)\s*</tool_call>", function, parameter, False), _xml("<tool_call>\n<function={name}>\n", "<parameter={k}>\n{v}\n</parameter>\n", "</function>\n</tool_call>", _nested)
    yield ToolFormat("qwen3_coder", *coder, lambda r: f"<tool_response>\n{r}\n</tool_response>\n", answers=("", "", ""))
    yield ToolFormat("qwen3_5", *coder, lambda r: f"<tool_response>\n{r}\n</tool_response>")
    yield ToolFormat("deepseek_v3_1", separator_calls, lambda n, v: f"<｜tool▁call▁begin｜>{n}<｜tool▁sep｜>{json.dumps(v, ensure_ascii=False)}<｜tool▁call▁end｜>", lambda r: f"<｜tool▁output▁begin｜>{r}<｜tool▁output▁end｜>", "", "<｜tool▁calls▁begin｜>", "<｜tool▁calls▁end｜>", ("", "", ""))
    yield ToolFormat(
        "minimax_m2",
        xml_calls(r"<minimax:tool_call>(.*?)</minimax:tool_call>", r"<invoke name=\"([^\"]+)\">(.*?)</invoke>", r"<parameter name=\"([^\"]+)\">(.*?)</parameter>", True),
        _xml('<invoke name="{name}">\n', '<parameter name="{k}">{v}</parameter>', "\n</invoke>", sep="\n"),
        lambda r: f"<response>{r}</response>",
        head="<minimax:tool_call>\n",
        tail="\n</minimax:tool_call>",
    )
    yield ToolFormat("mistral", first_block_calls, _json_call, lambda r: f"[TOOL_RESULTS]{json.dumps({'content': r}, ensure_ascii=False)}[/TOOL_RESULTS]", head="[TOOL_CALLS][\n", tail="\n]</s>")
    block = re.compile(r"<seed:tool_call>.+?</seed:tool_call>", re.S)
    seed = xml_calls(r"<seed:tool_call>(.*?)</seed:tool_call>", function, parameter, False, False)
    yield ToolFormat(
        "seed_oss",
        lambda t: (seed(t) or None) if block.search(t) else [],  # a block without calls means none
        _xml("<seed:tool_call>\n<function={name}>\n", "<parameter={k}>{v}</parameter>\n", "</function>\n</seed:tool_call>"),
        lambda r: f"<seed:bos>tool\n{r}<seed:eos>",
        answers=("<seed:eos>", "", "<seed:bos>assistant\n"),
    )
    yield ToolFormat("youtu", json_block, lambda n, v: f"<tool_call>{_json_call(n, v)}</tool_call>", lambda r: f"<tool_response>{r}</tool_response>", "")


FORMATS: dict[str, ToolFormat] = {f.name: f for f in _formats()}


def extract_calls(text: Column, form: str) -> Column:
    """array<struct<name, arguments>> of a response."""
    parser = FORMATS[form]

    @F.pandas_udf(CALLS)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield pd.Series([[{"name": n, "arguments": a} for n, a in parser.calls(x)] for x in s])

    return run(text)


#: Bytes of text that a batch's answers are made of at a time.
PART_BYTES = 1 << 18


def by_distinct(texts: pa.Array, kind: pa.DataType, make: Callable[[str], object]) -> Iterator[pa.Array]:
    """make(text) of every text in order, in parts of about PART_BYTES of text or one text that has more; null of null.
    Within a part each distinct text is made once."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))])
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART_BYTES, "right")) - 1)
        coded = texts.slice(at, to - at).dictionary_encode()
        yield pa.array([make(t) for t in coded.dictionary.to_pylist()], kind).take(coded.indices)
        at = to


def round_trips(name: str, arguments: Column) -> Column:
    """array<struct<format, name, arguments>>: what each format extracts from its own rendering of a row's call."""
    kind = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("format", "name", "arguments")]))
    made = pa.list_(pa.struct([(c, pa.string()) for c in ("format", "name", "arguments")]))

    def trips(text: str) -> list[dict]:
        value = text if (v := parse_value(text)) is None else v
        return [{"format": f.name, "name": n, "arguments": a} for f in FORMATS.values() for n, a in f.calls(f.render_values([(name, value)]))]

    @F.arrow_udf(kind)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            yield from by_distinct(texts, made, trips)

    return run(arguments)


def extract_hermes(text: Column) -> Column:
    """The calls of <tool_call> JSON blocks by expressions alone, for responses without other spellings."""
    bodies = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.+?)</tool_call>"), 1)
    made = F.transform(bodies, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(made, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def extract_react(text: Column) -> Column:
    """Action / Action Input pairs by expressions alone."""
    from parley.functions.text import strip

    whole = F.regexp_extract_all(text, F.lit(r"(?s)Action:(?:.*?)Action Input:(?:.*?)(?=Observation:|Action:|\z)"), 0)
    return F.transform(whole, lambda w: F.struct(strip(F.regexp_extract(w, r"(?s)Action:(.*?)Action Input:", 1)).alias("name"), strip(F.regexp_extract(w, r"(?s)Action Input:(.*)\z", 1)).alias("arguments")))


def merge_calls(messages: Column, form: str) -> Column:
    """Consecutive tool_call turns as one assistant turn in the format, and consecutive answers of tools as one turn; the fold
    is done in Python because calls parse. A content that is no call becomes the
    arguments of an empty name."""
    kind = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))
    tool = FORMATS[form]

    @F.pandas_udf(kind)
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            out = []
            for ms in s:
                made: list[dict] = []
                for kind, turns in groupby(ms if ms is not None else (), lambda m: {"tool": "tool_response"}.get(m["role"], m["role"])):
                    if kind == "tool_call":
                        values = [(m["content"] or "", parse_value(m["content"] or "")) for m in turns]
                        calls = [(str(v["name"]), dump(v.get("arguments", v.get("parameters", {})))) if isinstance(v, dict) and "name" in v else ("", x) for x, v in values]
                        made.append({"role": "assistant", "content": tool.render_calls(calls)})
                    elif kind == "tool_response":
                        made.append({"role": kind, "content": tool.render_results([m["content"] or "" for m in turns])})
                    else:
                        made += [{"role": m["role"], "content": m["content"]} for m in turns]
                out.append(made)
            yield pd.Series(out)

    return run(messages)
