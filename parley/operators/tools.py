"""Tool lists in prompts: each format shows the tools in the system prompt, or before the query.

A prompt is a text with the slots {{SYSTEM}}, {{TOOLS}} and {{NAMES}}, and a function that shows one tool. Tools come as a JSON
array of descriptions, bare or within {"type": "function", "function": ...}. Lists repeat over rows, so each distinct one is
read once per task.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.operators.agent import parse_value


def bare(tool: dict) -> dict:
    return tool["function"] if "type" in tool and "function" in tool else tool


def wrapped(tool: dict) -> dict:
    return tool if "type" in tool or "function" in tool else {"type": "function", "function": tool}


#: json.dumps without ASCII escapes; one encoder serves all calls.
_JSON = json.JSONEncoder(ensure_ascii=False).encode


def text(value, **how) -> str:
    return json.dumps(value, ensure_ascii=False, **how) if how else _JSON(value)


def name_of(tool: dict) -> str:
    t = bare(tool)
    return t.get("name_for_model") or t.get("name") or ""


# ---------------------------------------------------------------- fixed values: texts of the formats

ARGUMENTS_EN, ARGUMENTS_ZH = "Format the arguments as a JSON object.", "此工具的输入应为JSON对象。"
REACT_TOOL_EN = "{name}: Call this tool to interact with the {human} API. What is the {human} API useful for? {description} Parameters: {parameters} {arguments}"
REACT_TOOL_ZH = "{name}: 调用此工具与 {human} API 进行交互。{human} 有什么用？{description} 输入参数：{parameters} {arguments}"
QWEN_TOOL_EN = "### {human}\n\n{name}: {description} Parameters: {parameters} {arguments}"
QWEN_TOOL_ZH = "### {human}\n\n{name}: {description} 输入参数：{parameters} {arguments}"

REACT_EN = """Answer the following questions as best you can. You have access to the following tools:

{{TOOLS}}

Use the following format:

Question: the input question you must answer
Thought: you should always think about what to do
Action: the action to take, should be one of [{{NAMES}}]
Action Input: the input to the action
Observation: the result of the action
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Thought: I now know the final answer
Final Answer: the final answer to the original input question

Begin!
"""
REACT_ZH = """尽可能地回答以下问题。你可以使用以下工具:

{{TOOLS}}

请按照以下格式进行:

Question: 需要你回答的输入问题
Thought: 你应该总是思考该做什么
Action: 需要使用的工具，应该是[{{NAMES}}]中的一个
Action Input: 传入工具的内容
Observation: 行动的结果
... (这个Thought/Action/Action Input/Observation可以重复N次)
Thought: 我现在知道最后的答案
Final Answer: 对原始输入问题的最终答案

现在开始！
"""
REACT_GRPO = """A conversation for tool calling between User and Assistant. The user asks a question which may be solved by calling tools, and the Assistant solves it. The assistant first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning process should be enclosed within <think> </think>tags and answer should follow the ReACT format(Action:xxx
Action Input:xxx), i.e., <think> reasoning process here </think> Action: action here
Action Input: parameters here

Answer the following questions as best as you can. You have access to the following tools:

{{TOOLS}}

Use the following format:

<think>you should always think about what to do</think>
Action: the action to take, should be one of [{{NAMES}}]
Action Input: the input to the action
Observation: the result of the action, given by the actual calling
... (this Thought/Action/Action Input/Observation can be repeated zero or more times)
Final Answer: the final answer to the original input question

Begin!
"""
TOOLBENCH = """You can use many tools(functions) to do the following task.
First I will give you the task description, and your task start.
At each step, you need to give your thought to analyze the status now and what to do next, with a function call to actually execute your step. Your output should follow this format:
Thought:
Action:
Action Input:

After the call, you will get the call result, and you are now in a new state.
Then you will analyze your status now, then decide what to do next...
After many (Thought-call) pairs, you finally perform the task, then you can give your final answer.
Remember:
1.the state change is irreversible, you can't go back to one of the former state, if you want to restart the task, say "I give up and restart".
2.All the thought is short, at most in 5 sentence.
3.You can do more then one try, so if your plan is to continuously try some conditions, you can do one of the conditions per try.
Let's Begin!
Task description: You should use functions to help handle the real time user queries. Remember:
1.ALWAYS call "Finish" function at the end of the task. And the final answer should contain enough information to show to the user,If you can't handle the task, or you find that function calls always fail(the function is not valid now), use function Finish->give_up_and_restart.
2.Do not use origin tool names, use only subfunctions' names.
Specifically, you have access to the following APIs: [{{TOOLS}}]"""
QWEN_EN = """{{SYSTEM}}

# Tools

## You have access to the following tools:

{{TOOLS}}

## When you need to call a tool, please insert the following command in your reply, which can be called zero or multiple times according to your needs:

✿FUNCTION✿: The tool to use, should be one of [{{NAMES}}]
✿ARGS✿: The input of the tool
✿RESULT✿: Tool results
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)"""
QWEN_ZH = """{{SYSTEM}}

# 工具

## 你拥有如下工具：

{{TOOLS}}

## 你可以在回复中插入零次、一次或多次以下命令以调用工具：

✿FUNCTION✿: 工具名称，必须是[{{NAMES}}]之一。
✿ARGS✿: 工具输入
✿RESULT✿: 工具结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"""
QWEN_EN_PARALLEL = """{{SYSTEM}}

# Tools

## You have access to the following tools:

{{TOOLS}}

## Insert the following command in your reply when you need to call N tools in parallel:

✿FUNCTION✿: The name of tool 1, should be one of [{{NAMES}}]
✿ARGS✿: The input of tool 1
✿FUNCTION✿: The name of tool 2
✿ARGS✿: The input of tool 2
...
✿FUNCTION✿: The name of tool N
✿ARGS✿: The input of tool N
✿RESULT✿: The result of tool 1
✿RESULT✿: The result of tool 2
...
✿RESULT✿: he result of tool N
✿RETURN✿: Reply based on tool results. Images need to be rendered as ![](url)"""
QWEN_ZH_PARALLEL = """{{SYSTEM}}

# 工具

## 你拥有如下工具：

{{TOOLS}}

## 你可以在回复中插入以下命令以并行调用N个工具：

✿FUNCTION✿: 工具1的名称，必须是[{{NAMES}}]之一
✿ARGS✿: 工具1的输入
✿FUNCTION✿: 工具2的名称
✿ARGS✿: 工具2的输入
...
✿FUNCTION✿: 工具N的名称
✿ARGS✿: 工具N的输入
✿RESULT✿: 工具1的结果
✿RESULT✿: 工具2的结果
...
✿RESULT✿: 工具N的结果
✿RETURN✿: 根据工具结果进行回复，需将图片用![](url)渲染出来"""
HERMES = """{{SYSTEM}}

# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{{TOOLS}}
</tools>

For each function call, return a json object with function name and arguments within <tool_call></tool_call> XML tags:
<tool_call>
{"name": <function-name>, "arguments": <args-json-object>}
</tool_call>"""
HUNYUAN_HERMES = """{{SYSTEM}}# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{{TOOLS}}
</tools>

For function call returns, you should first print <tool_calls>For each function call, you should return object like:
<tool_call>function_name
```json
function_arguments_in_json_format
```</tool_call>At the end of function call returns, you should print </tool_calls>"""
YOUTU = """{{SYSTEM}}<|begin_of_tool_description|>Tool calling capabilities.
You may call one or more functions to assist with the user query. You have the following functions available:
{{TOOLS}}
For tool call returns, you MUST use the following format:
<tool_call>{"name": "function-name", "arguments": {"param1": "value1", "param2": "value2"}}</tool_call>
<|end_of_tool_description|>"""
LLAMA_QUERY = """Given the following functions, please respond with a JSON for a function call with its proper arguments that best answers the given prompt.

Respond in the format {"name": function name, "parameters": dictionary of argument name and its value}. Do not use variables.

{{TOOLS}}

{{QUERY}}"""
GLM4 = "# 可用工具\n\n{{TOOLS}}"
CHATGLM4_SYSTEM = "你是一个名为 GLM-4 的人工智能助手。你是基于智谱AI训练的语言模型 GLM-4 模型开发的，你的任务是针对用户的问题和要求提供适当的答复和支持。\n\n"
GLM4_TOOL = "## {name}\n\n{tool}\n在调用上述函数时，请使用 Json 格式表示调用的参数。"
GLM4_5 = """# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{{TOOLS}}
</tools>

For each function call, output the function name and arguments within the following XML format:
<tool_call>{function-name}
<arg_key>{arg-key-1}</arg_key>
<arg_value>{arg-value-1}</arg_value>
<arg_key>{arg-key-2}</arg_key>
<arg_value>{arg-value-2}</arg_value>
...
</tool_call>{{SYSTEM}}"""
GLM4_7 = """# Tools

You may call one or more functions to assist with the user query.

You are provided with function signatures within <tools></tools> XML tags:
<tools>
{{TOOLS}}
</tools>

For each function call, output the function name and arguments within the following XML format:
<tool_call>{function-name}<arg_key>{arg-key-1}</arg_key><arg_value>{arg-value-1}</arg_value><arg_key>{arg-key-2}</arg_key><arg_value>{arg-value-2}</arg_value>...</tool_call>{{SYSTEM}}"""
CODER_END = """</tools>

If you choose to call a function ONLY reply in the following format with NO suffix:

<tool_call>
<function=example_function_name>
<parameter=example_parameter_1>
value_1
</parameter>
<parameter=example_parameter_2>
This is the value for the second parameter
that can span
multiple lines
</parameter>
</function>
</tool_call>

<IMPORTANT>
Reminder:
- Function calls MUST follow the specified format: an inner <function=...></function> block must be nested within <tool_call></tool_call> XML tags
- Required parameters MUST be specified
- You may provide optional reasoning for your function call in natural language BEFORE the function call, but NOT after
- If there is no function call available, answer the question like normal with your current knowledge and do not tell the user about function calls
</IMPORTANT>"""
CODER = "{{SYSTEM}}\n\n# Tools\n\nYou have access to the following functions:\n\n<tools>\n{{TOOLS}}\n" + CODER_END
CODER_SYSTEM = "You are Qwen, a helpful AI assistant that can interact with a computer to solve tasks."
QWEN3_5 = "# Tools\n\nYou have access to the following functions:\n\n<tools>\n{{TOOLS}}\n" + CODER_END + "{{SYSTEM}}"
DEEPSEEK_TOOL = "### {name}\nDescription: {description}\n\nParameters: {parameters}"
DEEPSEEK = """{{SYSTEM}}

## Tools
You have access to the following tools:

{{TOOLS}}

IMPORTANT: ALWAYS adhere to this exact format for tool use:
<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>tool_call_name<｜tool▁sep｜>tool_call_arguments<｜tool▁call▁end｜>{additional_tool_calls}<｜tool▁calls▁end｜>

Where:
- `tool_call_name` must be an exact match to one of the available tools
- `tool_call_arguments` must be valid JSON that strictly follows the tool's Parameters Schema
- For multiple tool calls, chain them directly without separators or spaces"""
MINIMAX = """{{SYSTEM}}

# Tools
You may call one or more tools to assist with the user query.
Here are the tools available in JSONSchema format:

<tools>
{{TOOLS}}
</tools>

When making tool calls, use XML format to invoke tools and pass parameters:

<minimax:tool_call>
<invoke name="tool-name-1">
<parameter name="param-key-1">param-value-1</parameter>
<parameter name="param-key-2">param-value-2</parameter>
...
</invoke>
</minimax:tool_call>"""
MISTRAL = "{{SYSTEM}}[AVAILABLE_TOOLS]{{TOOLS}}[/AVAILABLE_TOOLS]"
SEED_CALL = """工具调用请遵循如下格式:
<seed:tool_call>
<function=example_function_name>
<parameter=example_parameter_1>value_1</parameter>
<parameter=example_parameter_2>This is the value for the second parameter
that can span
multiple lines</parameter>
</function>
</seed:tool_call>"""
SEED_SYSTEM = "You are Doubao, a helpful AI assistant. You may call one or more functions to assist with the user query."
SEED_BREAK = "<seed:eos><seed:bos>system"
SEED_TYPES = {"string": "str", "number": "int", "integer": "int", "boolean": "bool", "array": "list"}

# ---------------------------------------------------------------- one tool


def sentence(pattern: str, arguments: str) -> Callable[[dict], str]:
    """A tool as a sentence; one without a name or a description is an error, since no model could choose it."""

    def show(tool: dict) -> str:
        t = bare(tool)
        name, about, given = name_of(t), t.get("description", t.get("description_for_model")), t.get("parameters") or {}
        if not name or about is None:
            raise ValueError(f"a tool needs a name and a description: {text(tool)}")
        return pattern.format(name=name, human=t.get("name_for_human") or name, description=about, parameters=given if isinstance(given, str) else text(given), arguments=arguments)

    return show


def _rest(fields, shown: tuple[str, ...]) -> list[str]:
    return [f"<{k}>{text(v)}</{k}>" for k, v in fields.items() if k not in shown] if isinstance(fields, dict) else []


def coder_tool(tool: dict) -> str:
    """A tool as nested tags, a line each; fields without a tag of their own follow as JSON."""
    t = tool["function"] if "function" in tool else tool
    about = [f"<description>{t['description'].strip()}</description>"] if "description" in t else []
    lines = [f"<function>\n<name>{name_of(t)}</name>", *about, "<parameters>"]
    given = t.get("parameters")
    named = given.get("properties") if isinstance(given, dict) else None
    for name, fields in named.items() if isinstance(named, dict) else ():
        lines += ["<parameter>", f"<name>{name}</name>"]
        lines += [f"<type>{fields['type']}</type>"] if "type" in fields else []
        lines += [f"<description>{fields['description'].strip()}</description>"] if "description" in fields else []
        lines += [*_rest(fields, ("name", "type", "description")), "</parameter>"]
    return "\n".join([*lines, *_rest(given, ("type", "properties")), "</parameters>", *_rest(t, ("type", "name", "description", "parameters")), "</function>"])


def python_tool(tool: dict) -> str:
    """A tool as a Python definition with its arguments and results in the docstring; '' without a name."""
    t = wrapped(tool).get("function") or {}
    if wrapped(tool).get("type") != "function" or not t.get("name"):
        return ""

    def rows(fields: dict, needed: list[str] | None) -> list[str]:
        marks = {k: "" if needed is None else " [必填]" if k in needed else " [选填]" for k in fields}
        return [f"    - {k} ({kind(v)}){marks[k]}: {v.get('description', '')}" for k, v in fields.items() if isinstance(v, dict)]

    def kind(fields: dict) -> str:
        return SEED_TYPES.get(fields.get("type", "any"), "Any")

    given = (t.get("parameters") or {}).get("properties") or {}
    made = (t.get("returns") or {}).get("properties") or {}
    lines = ['    """', f"    {t.get('description', '').strip()}"]
    lines += ["\n    Args:", *rows(given, t["parameters"].get("required", []))] if given else []
    lines += ["\n    Returns:", *rows(made, None)] if made else []
    head = ",".join(f"{k}: {kind(v)}" for k, v in given.items() if isinstance(v, dict))
    return f"Function:\ndef {t['name']}({head}):\n" + "\n".join([*lines, '\n    """'])


# ---------------------------------------------------------------- a prompt


def _spaced(system: str | None) -> str:
    return f"{system}\n\n" if system else ""


def _after(mark: str) -> Callable[[str | None], str]:
    return lambda system: mark + system.strip() if system and system.strip() else ""


@dataclass(frozen=True)
class ToolPrompt:
    """`system` fits a given system prompt into its slot; with `query`, the tools stand there and the system prompt stays."""

    prompt: str
    show: Callable[[dict], str] = lambda t: text(wrapped(t))
    sep: str = "\n"
    system: Callable[[str | None], str] = lambda s: s or ""
    query: bool = False

    def tools(self, tools: list[dict]) -> str:
        return self.sep.join(shown for t in tools if (shown := self.show(t)))

    def fill(self, tools: list[dict], system: str | None, query: str | None) -> tuple[str, str | None]:
        """(system prompt, query) with the tools in the one that the format has them in."""
        slots = {"{{TOOLS}}": self.tools(tools), "{{NAMES}}": ",".join(map(name_of, tools)), "{{SYSTEM}}": self.system(system), "{{QUERY}}": query or ""}
        out, at = [], 0
        while (start := self.prompt.find("{{", at)) >= 0:  # in one pass: what fills a slot isn't searched for slots
            end = self.prompt.index("}}", start) + 2
            out += [self.prompt[at:start], slots[self.prompt[start:end]]]
            at = end
        whole = "".join([*out, self.prompt[at:]])
        return (system or "", whole) if self.query else (whole, query)


@dataclass(frozen=True)
class SeedPrompt(ToolPrompt):
    """The tools stand before a break between system prompts: that of the given prompt, else one behind a fixed text."""

    def fill(self, tools: list[dict], system: str | None, query: str | None) -> tuple[str, str | None]:
        first, broken, rest = (system or "").partition(SEED_BREAK)
        first, rest = (first, rest) if broken else (SEED_SYSTEM, f"\n{system or ''}")
        return f"{first}\n\n{self.tools(tools)}\n{SEED_CALL}\n{SEED_BREAK}{rest}", query


def _glm4(tool: dict) -> str:
    return GLM4_TOOL.format(name=name_of(tool), tool=text(bare(tool), indent=4))


def _deepseek(tool: dict) -> str:
    t = bare(tool)
    return DEEPSEEK_TOOL.format(name=name_of(t), description=t.get("description", ""), parameters=text(t.get("parameters", {})))


_LLAMA = ToolPrompt(LLAMA_QUERY, lambda t: text(t, indent=4), "\n\n", query=True)
PROMPTS: dict[str, ToolPrompt] = {
    "react_en": ToolPrompt(REACT_EN, sentence(REACT_TOOL_EN, ARGUMENTS_EN), "\n\n"),
    "react_zh": ToolPrompt(REACT_ZH, sentence(REACT_TOOL_ZH, ARGUMENTS_ZH), "\n\n"),
    "react_grpo": ToolPrompt(REACT_GRPO, sentence(REACT_TOOL_EN, ARGUMENTS_EN), "\n\n"),
    "toolbench": ToolPrompt(TOOLBENCH, lambda t: text(bare(t)), ", "),
    "qwen_en": ToolPrompt(QWEN_EN, sentence(QWEN_TOOL_EN, ARGUMENTS_EN), "\n\n"),
    "qwen_zh": ToolPrompt(QWEN_ZH, sentence(QWEN_TOOL_ZH, ARGUMENTS_ZH), "\n\n"),
    "qwen_en_parallel": ToolPrompt(QWEN_EN_PARALLEL, sentence(QWEN_TOOL_EN, ARGUMENTS_EN), "\n\n"),
    "qwen_zh_parallel": ToolPrompt(QWEN_ZH_PARALLEL, sentence(QWEN_TOOL_ZH, ARGUMENTS_ZH), "\n\n"),
    "hermes": ToolPrompt(HERMES),
    "hunyuan_hermes": ToolPrompt(HUNYUAN_HERMES, system=_spaced),
    "llama3": _LLAMA,
    "llama4": _LLAMA,
    "chatglm4": ToolPrompt(CHATGLM4_SYSTEM + GLM4, _glm4),
    "glm4": ToolPrompt(GLM4, _glm4),
    "glm4_5": ToolPrompt(GLM4_5, text, system=_after("<|system|>\n")),
    "glm4_7": ToolPrompt(GLM4_7, text, system=_after("<|system|>\n")),
    "qwen3_coder": ToolPrompt(CODER, coder_tool, system=lambda s: CODER_SYSTEM if s is None else s),
    "qwen3_5": ToolPrompt(QWEN3_5, system=lambda s: f"\n\n{s}" if s else ""),
    "deepseek_v3_1": ToolPrompt(DEEPSEEK, _deepseek, "\n\n"),
    "minimax_m2": ToolPrompt(MINIMAX, lambda t: f"<tool>{text(bare(t))}</tool>"),
    "mistral": ToolPrompt(MISTRAL, sep=" "),
    "seed_oss": SeedPrompt("", python_tool, "\n\n"),
    "youtu": ToolPrompt(YOUTU, lambda t: f"```json\n{text(wrapped(t))}\n```", system=_spaced),
}


def fill_prompt(form: str, tools: list[dict], system: str | None = None, query: str | None = None) -> tuple[str, str | None]:
    """(system prompt, query) with the tools shown; in glm4_7 a line break leads where no system prompt is given."""
    made = PROMPTS[form].fill(tools, system, query)
    return (f"\n{made[0]}", made[1]) if form == "glm4_7" and not (system or "").strip() else made


def _fill(form: str, tools: list[dict], system: str | None, query: str | None) -> tuple[str | None, str | None]:
    try:
        return fill_prompt(form, tools, system, query)
    except (ValueError, TypeError, KeyError, AttributeError):
        return None, None


def read_tools(tools: str | None) -> list[dict]:
    """The descriptions of a JSON array or object, or of an array of their JSON texts; others are left out."""
    value = parse_value(tools) if tools else None
    every = [parse_value(t) if isinstance(t, str) else t for t in (value if isinstance(value, list) else [value])]
    return [t for t in every if isinstance(t, dict)]


def tool_prompt(tools: Column, system: Column, query: Column, form: str) -> Column:
    """struct<system, query> with a row's tools (JSON text) shown in the format. Rows without tools keep both as they are; both
    are null where a tool can't be shown, as without a name."""

    @F.pandas_udf(T.StructType([T.StructField("system", T.StringType()), T.StructField("query", T.StringType())]))
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        read = lru_cache(maxsize=256)(read_tools)
        for ts, ss, qs in parts:
            rows = [(t, None if pd.isna(s) else s, None if pd.isna(q) else q) for t, s, q in zip(ts, ss, qs)]
            made = [_fill(form, found, s, q) if (found := read(t)) else (s, q) for t, s, q in rows]
            yield pd.DataFrame({"system": pd.Series([m[0] for m in made], dtype=object), "query": pd.Series([m[1] for m in made], dtype=object)})

    return run(tools, system.cast("string"), query.cast("string"))


#: Rows whose prompts in several formats are held at a time.
PROMPT_ROWS = 256


def tool_prompts(tools: Column, system: Column, query: Column, forms: list[str]) -> Column:
    """array<struct<format, system, query>>: tool_prompt in each of several formats, by one Python worker for all of them. A
    row's tools are read once, and PROMPT_ROWS rows are given out at a time."""
    fields = ("format", "system", "query")
    made = pa.list_(pa.struct([(c, pa.string()) for c in fields]))

    @F.arrow_udf(T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in fields])))
    def run(parts: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        read = lru_cache(maxsize=256)(read_tools)
        for columns in parts:
            for at in range(0, len(columns[0]), PROMPT_ROWS):
                rows = []
                for t, s, q in zip(*[c.slice(at, PROMPT_ROWS).to_pylist() for c in columns]):
                    found = read(t)
                    rows.append([dict(zip(fields, (f, *(_fill(f, found, s, q) if found else (s, q))))) for f in forms])
                yield pa.array(rows, made)

    return run(tools, system.cast("string"), query.cast("string"))
