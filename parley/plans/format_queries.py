"""Registered queries of tool formats, templates and readers, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.operators import agent as A
from parley.operators import encode as E
from parley.operators import normalize as N
from parley.operators import render as R
from parley.plans.load import load
from parley.plans.queries import _CHAT, _RENDERED, _SYSTEMS, ORACLE_SQL, QUERIES, conversations, query
from parley.sources.readers import read_file, read_folder

# ---------------------------------------------------------------- calls and answers of tools

#: What a turn of two calls looks like in SQL, of a JSON object p with the one key k, its literal q and its value v; and the
#: turn of their answers a and b.
_N = "chr(10)"
_TURNS = {
    "agt02_react_turns": ("react_zh", f"'Action: f' || {_N} || 'Action Input: ' || q || {_N} || 'Action: g' || {_N} || 'Action Input: {{}}' || {_N} || 'Observation:'", f"a || {_N} || 'Observation:' || b || {_N}"),
    "agt03_keyword_turns": ("qwen_zh_parallel", f"'✿FUNCTION✿: f' || {_N} || '✿ARGS✿: ' || q || {_N} || '✿FUNCTION✿: g' || {_N} || '✿ARGS✿: {{}}' || {_N} || '✿RESULT✿:'", f"a || {_N} || '✿RESULT✿:' || b || {_N}"),
    "agt04_wrapped_turns": (
        "hunyuan_hermes",
        f"'<tool_calls>' || {_N} || '<tool_call>' || {_N} || '{{\"name\": \"f\", \"arguments\": ' || p || '}}' || {_N} || '</tool_call>' || {_N} || '<tool_call>' || {_N} || '{{\"name\": \"g\", \"arguments\": {{}}}}' || {_N} || '</tool_call>' || {_N} || '</tool_calls>'",
        f"'<tool_responses><tool_response>' || a || '</tool_response>' || {_N} || '<tool_response>' || b || '</tool_response></tool_responses>'",
    ),
    "agt05_header_turns": (
        "llama3",
        f"'{{\"name\": \"f\", \"parameters\": ' || p || '}}' || {_N} || '{{\"name\": \"g\", \"parameters\": {{}}}}'",
        f"'<|eot_id|><|start_header_id|>tool<|end_header_id|>' || {_N} || {_N} || a || '<|eot_id|><|start_header_id|>tool<|end_header_id|>' || {_N} || {_N} || b || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || {_N} || {_N}",
    ),
    "agt06_name_line_turns": ("glm4", f"'f' || {_N} || q || '<|assistant|>g' || {_N} || '{{}}<|observation|>'", f"{_N} || a || '<|observation|>' || {_N} || b || '<|assistant|>' || {_N}"),
    "agt06_key_value_turns": (
        "glm4_5",
        f"'<tool_call>f' || {_N} || '<arg_key>k</arg_key>' || {_N} || '<arg_value>' || v || '</arg_value>' || {_N} || '</tool_call>' || {_N} || '<tool_call>g' || {_N} || '</tool_call><|observation|>'",
        f"{_N} || '<tool_response>' || {_N} || a || {_N} || '</tool_response>' || {_N} || '<tool_response>' || {_N} || b || {_N} || '</tool_response><|assistant|>' || {_N}",
    ),
    "agt07_tag_turns": (
        "qwen3_coder",
        f"'<tool_call>' || {_N} || '<function=f>' || {_N} || '<parameter=k>' || {_N} || v || {_N} || '</parameter>' || {_N} || '</function>' || {_N} || '</tool_call>' || {_N} || '<tool_call>' || {_N} || '<function=g>' || {_N} || '</function>' || {_N} || '</tool_call>'",
        f"'<tool_response>' || {_N} || a || {_N} || '</tool_response>' || {_N} || '<tool_response>' || {_N} || b || {_N} || '</tool_response>' || {_N}",
    ),
    "agt08_separator_turns": (
        "deepseek_v3_1",
        "'<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>f<｜tool▁sep｜>' || p || '<｜tool▁call▁end｜><｜tool▁call▁begin｜>g<｜tool▁sep｜>{}<｜tool▁call▁end｜><｜tool▁calls▁end｜>'",
        "'<｜tool▁output▁begin｜>' || a || '<｜tool▁output▁end｜><｜tool▁output▁begin｜>' || b || '<｜tool▁output▁end｜>'",
    ),
    "agt09_invoke_turns": (
        "minimax_m2",
        f"'<minimax:tool_call>' || {_N} || '<invoke name=\"f\">' || {_N} || '<parameter name=\"k\">' || v || '</parameter>' || {_N} || '</invoke>' || {_N} || '<invoke name=\"g\">' || {_N} || {_N} || '</invoke>' || {_N} || '</minimax:tool_call>'",
        f"'<response>' || a || '</response>' || {_N} || '<response>' || b || '</response>'",
    ),
    "agt10_block_turns": (
        "mistral",
        f"'[TOOL_CALLS][' || {_N} || '{{\"name\": \"f\", \"arguments\": ' || p || '}}' || {_N} || '{{\"name\": \"g\", \"arguments\": {{}}}}' || {_N} || ']</s>'",
        f"'[TOOL_RESULTS]{{\"content\": \"' || a || '\"}}[/TOOL_RESULTS]' || {_N} || '[TOOL_RESULTS]{{\"content\": \"' || b || '\"}}[/TOOL_RESULTS]'",
    ),
    "agt11_function_turns": (
        "seed_oss",
        f"'<seed:tool_call>' || {_N} || '<function=f>' || {_N} || '<parameter=k>' || v || '</parameter>' || {_N} || '</function>' || {_N} || '</seed:tool_call>' || {_N} || '<seed:tool_call>' || {_N} || '<function=g>' || {_N} || '</function>' || {_N} || '</seed:tool_call>'",
        f"'<seed:eos><seed:bos>tool' || {_N} || a || '<seed:eos><seed:bos>tool' || {_N} || b || '<seed:eos><seed:bos>assistant' || {_N}",
    ),
}


def _turns(form: str):
    def run(table) -> DataFrame:
        call = lambda name, body: F.concat(F.lit(f'{{"name": "{name}", "arguments": '), body, F.lit("}"))
        said = [("user", F.col("event_type")), ("tool_call", call("f", F.col("props"))), ("tool_call", call("g", F.lit("{}"))), ("tool", F.col("event_type")), ("tool_response", F.col("user_id").cast("string")), ("assistant", F.lit("done"))]
        messages = F.array(*[F.struct(F.lit(role).alias("role"), content.alias("content")) for role, content in said])
        d = table("events").select("event_id", A.merge_calls(messages, form).alias("m"))
        return d.select("event_id", F.size("m").alias("turns"), F.col("m")[1]["content"].alias("calls"), F.col("m")[2]["content"].alias("answers"))

    return run


for _name, (_form, _calls, _answers) in _TURNS.items():
    _run = _turns(_form)
    _run.__name__ = _name
    query(f"""SELECT event_id, 4 AS turns, {_calls} AS calls, {_answers} AS answers
FROM (SELECT event_id, props AS p, replace(props, '"', '''') AS q, json_extract_string(props, '$.k') AS v, event_type AS a, user_id::VARCHAR AS b FROM events)""")(_run)


@query("SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'f' END AS name, CASE WHEN event_id % 3 = 1 THEN props END AS arguments, (event_id % 3 = 1)::INTEGER AS calls FROM events")
def agt14_fallback(table):
    """A block without calls has none in seed_oss; Action lines are read where there is no block."""
    react = F.concat(F.lit("Action: f\nAction Input: "), "props")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("<seed:tool_call>nothing</seed:tool_call>\n"), react)).when(F.col("event_id") % 3 == 1, react).otherwise(F.lit("no call"))
    d = table("events").select("event_id", A.extract_calls(text, "seed_oss").alias("c"))
    return d.select("event_id", F.try_element_at("c", F.lit(1))["name"].alias("name"), F.try_element_at("c", F.lit(1))["arguments"].alias("arguments"), F.size("c").alias("calls"))


# ---------------------------------------------------------------- templates


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Each template in SQL: head with and without a system prompt, text before and after a query, between rounds, at the end.
_TEMPLATES = {
    "plain": ("''", "", "", "", "", ""),
    "header": ("'<|begin_of_text|><|start_header_id|>system<|end_header_id|>\n\n' || system || '<|eot_id|>'", "<|begin_of_text|>", "<|start_header_id|>user<|end_header_id|>\n\n", "<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|eot_id|>", "<|eot_id|>"),
    "inst": ("'<s>[INST] <<SYS>>\n' || system || '\n<</SYS>>\n\n'", "<s>[INST] ", "", " [/INST]", "</s><s>[INST] ", "</s>"),
}


def _rendered(form: str):
    def run(table) -> DataFrame:
        d = conversations(table).select("conv_id", N.split_system(F.col("messages")).alias("p"))
        return d.select("conv_id", F.md5(R.text_of(R.segments(R.TEMPLATES[form], F.col("p.system"), F.col("p.messages")))).alias("text"))

    return run


for _form, (_with, _without, _before, _after, _between, _end) in _TEMPLATES.items():
    _run = _rendered(_form)
    _run.__name__ = f"rnd03_{_form}_template"
    query(f"""{_CHAT}, g AS (SELECT *, max(j) OVER (PARTITION BY conv_id) // 2 AS final FROM l),
x AS (SELECT conv_id, string_agg(CASE WHEN j % 2 = 0 OR i = 0 THEN {_quoted(_before)} || CASE WHEN j % 2 = 0 THEN text ELSE '' END || {_quoted(_after)} ELSE '' END
 || CASE WHEN j % 2 = 1 THEN text || CASE WHEN j // 2 < final THEN {_quoted(_between)} ELSE {_quoted(_end)} END ELSE '' END, '' ORDER BY i) AS body FROM g GROUP BY conv_id)
SELECT conv_id, md5(CASE WHEN system IS NULL THEN {_quoted(_without)} ELSE {_with} END || coalesce(body, '')) AS text FROM {_SYSTEMS} LEFT JOIN x USING (conv_id)""")(_run)


# ---------------------------------------------------------------- readers


def _of_path(name: str, sql: str):
    """Registers a function of (spark, sf_dir), for what reads files itself."""

    def add(function):
        QUERIES[name], ORACLE_SQL[name] = function, sql
        return function

    return add


@_of_path("src01_read_file", "SELECT doc_id, md5(text) AS text, n_chars FROM documents")
def _read_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_file(spark, f"{sf_dir}/documents.parquet").select("doc_id", F.md5("text").alias("text"), "n_chars")


@_of_path("src02_read_folder", "SELECT 'p' || page_id AS id, url AS body FROM pages UNION ALL SELECT 'd' || doc_id, text FROM documents")
def _read_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two splits of a folder, united by name."""
    d = read_folder(spark, sf_dir, splits=("pages", "documents"))
    page = F.col("page_id").isNotNull()
    return d.select(F.when(page, F.concat(F.lit("p"), "page_id")).otherwise(F.concat(F.lit("d"), "doc_id")).alias("id"), F.when(page, F.col("url")).otherwise(F.col("text")).alias("body"))


@_of_path("src11_load", "SELECT md5('user:' || source || '|assistant:' || text) AS turns FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def _load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference loaded to canonical messages."""
    train, _ = load(spark, f"{sf_dir}/documents.parquet", columns={"source": "query", "text": "response"})
    return train.select(F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("turns"))


@_of_path("src11_load_split", "SELECT 2 * count(*) - 2 * greatest(count(*) // 20, 1) AS train, 2 * greatest(count(*) // 20, 1) AS val FROM documents WHERE source IS NOT NULL AND text IS NOT NULL")
def _load_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two references, each split by itself."""
    path = f"{sf_dir}/documents.parquet"
    train, val = load(spark, [path, path], ratio=0.05, columns={"source": "query", "text": "response"})
    return train.select(F.lit(1).alias("t"), F.lit(0).alias("v")).unionAll(val.select(F.lit(0), F.lit(1))).agg(F.sum("t").alias("train"), F.sum("v").alias("val"))


# ---------------------------------------------------------------- encoding


def _bytes_digest():
    return F.md5(F.array_join(F.transform("input_ids", lambda x: F.lpad(F.hex(x), 2, "0")), "")).alias("ids")


_BYTES = f"""{_CHAT}, x AS (SELECT conv_id, {_RENDERED} AS body, coalesce(sum(CASE WHEN j % 2 = 1 THEN octet_length(encode(text)) END), 0) + CASE WHEN max(j) % 2 = 1 THEN 11 ELSE 0 END AS trained FROM l GROUP BY conv_id),
h AS (SELECT conv_id, coalesce(trained, 0)::BIGINT AS trained, hex(encode(coalesce('<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10), '') || coalesce(body, ''))) AS hex FROM {_SYSTEMS} LEFT JOIN x USING (conv_id))"""


@query(f"{_BYTES} SELECT conv_id, (length(hex) // 2)::INTEGER AS length, md5(hex) AS ids, trained FROM h")
def rnd01_encode(table):
    """Whole conversations as ids and labels, of a tokenizer of bytes."""
    d = E.encode(conversations(table), R.TEMPLATES["chatml"], E.Encoder())
    return d.select("conv_id", "length", _bytes_digest(), F.size(F.filter("labels", lambda y: y != E.IGNORE)).cast("bigint").alias("trained"))


@query(f"{_BYTES} SELECT conv_id, least(length(hex) // 2, 512)::INTEGER AS length, md5(right(hex, 1024)) AS ids FROM h")
def rnd19_encode_left(table):
    """Cut to the last 512 tokens."""
    return E.encode(conversations(table), R.TEMPLATES["chatml"], E.Encoder(most=512, strategy="left")).select("conv_id", "length", _bytes_digest())


@query(f"{_BYTES} SELECT conv_id, md5(substr(hex, 1 + w * 1024, 1024)) AS ids, (length(substr(hex, 1 + w * 1024, 1024)) // 2)::INTEGER AS length FROM (SELECT *, unnest(range(greatest((length(hex) + 1023) // 1024, 1))) AS w FROM h)")
def rnd19_encode_split(table):
    """Windows of 512 tokens."""
    return E.encode(conversations(table), R.TEMPLATES["chatml"], E.Encoder(most=512, strategy="split")).select("conv_id", _bytes_digest(), "length")


@query(f"{_BYTES} SELECT conv_id, (length(hex) // 2)::INTEGER AS length FROM h WHERE length(hex) <= 4096")
def flt05_encode_delete(table):
    """What is longer than 2,048 tokens goes."""
    return E.encode(conversations(table), R.TEMPLATES["chatml"], E.Encoder(most=2048)).select("conv_id", "length")


@query(f"{_BYTES} SELECT conv_id, (length(hex) // 2)::INTEGER AS chosen_length, (length(hex) // 2)::INTEGER AS rejected_length, trained AS chosen_trained FROM h")
def rnd21_encode_preference(table):
    """A pair of equal conversations."""
    d = conversations(table).withColumn("rejected_messages", F.col("messages"))
    d = E.encode_preference(d, R.TEMPLATES["chatml"], E.Encoder())
    return d.select("conv_id", "chosen_length", "rejected_length", F.size(F.filter("chosen_labels", lambda y: y != E.IGNORE)).cast("bigint").alias("chosen_trained"))


@query()
def rnd01_encode_bpe(table):
    """Every document as the answer to its source, in ids of a public byte-level tokenizer; tests hold the ids against the
    tokenizer's own library."""
    import public_tokenizers

    spec = E.Tokenizer("ranks", public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    d = table("documents").select("doc_id", F.array(N.message("user", F.coalesce("source", F.lit(""))), N.message("assistant", F.coalesce("text", F.lit("")))).alias("messages"))
    d = E.encode(d, R.TEMPLATES["chatml"], E.Encoder(spec))
    return d.select("doc_id", "length", F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids"), F.size(F.filter("labels", lambda y: y != E.IGNORE)).alias("trained"))
