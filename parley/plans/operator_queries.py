"""More registered queries, one for each operator that parley.plans.queries leaves out, with the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions import text as T
from parley.operators import groupstats as G
from parley.operators import metrics as M
from parley.operators import normalize as N
from parley.operators import ordering as O
from parley.operators import pack as P
from parley.operators import preference as S
from parley.operators import render as R
from parley.operators import rewards as RW
from parley.operators import transforms as X
from parley.operators import validate as V
from parley.operators import windows as W
from parley.plans.queries import conversations, messages_of, query, r


def told(messages: Column | str) -> Column:
    """Roles and contents of messages, as a digest."""
    return F.md5(F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|"))


def said(*turns: tuple[str, str]) -> str:
    """The same in SQL, of (role, expression) turns."""
    return "md5(" + " || '|' || ".join(f"'{role}:' || ({body})" for role, body in turns) + ")"


def listed(columns: str, sql: str):
    """A query of whose result the named arrays are shown as texts, items set apart by commas."""
    names = columns.split()

    def add(function):
        def run(table):
            return function(table).withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in names})

        run.__name__ = function.__name__
        return query(f"SELECT * REPLACE ({', '.join(f'array_to_string({c}::VARCHAR[], {chr(39)},{chr(39)}) AS {c}' for c in names)}) FROM ({sql})")(run)

    return add


NL = "chr(10)"
STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"

# ---------------------------------------------------------------- projections


@query("SELECT doc_id, md5(text) AS content, lang, source FROM documents")
def prj01_safe_rename(table):
    """Two columns with one target stay as they are; names match without regard to case."""
    d = N.safe_rename(table("documents"), {"TEXT": "content", "lang": "tag", "source": "tag"})
    return d.select("doc_id", F.md5("content").alias("content"), "lang", "source")


@query("SELECT doc_id, lang AS query, source AS response, source AS solution FROM documents")
def prj03_rename_both(table):
    d = N.rename_both(table("documents").select("doc_id", F.col("lang").alias("words"), F.col("source").alias("solution")), {"words": "prompt"})
    return d.select("doc_id", "query", "response", "solution")


@listed("videos", "SELECT page_id, url AS path, true AS empty, [url] AS videos FROM pages")
def prj06_cast_media(table):
    d = N.cast_media(table("pages").select("page_id", F.col("url").alias("images"), F.col("url").alias("videos")))
    return d.select("page_id", F.col("images")[0]["path"].alias("path"), F.col("images")[0]["bytes"].isNull().alias("empty"), "videos")


@query("SELECT p_partkey, least(p_size, 25)::DOUBLE AS x1, least(p_partkey % 40, 20)::DOUBLE AS y1, greatest(p_size, 25)::DOUBLE AS x2, greatest(p_partkey % 40, 20)::DOUBLE AS y2 FROM part")
def prj07_objects(table):
    box = F.array(*[c.cast("double") for c in (F.col("p_size"), F.col("p_partkey") % 40, F.lit(25), F.lit(20))])
    objects = F.struct(F.array("p_name").alias("ref"), F.array(box).alias("bbox"), F.lit("real").alias("bbox_type"), F.lit(None).cast("array<bigint>").alias("image_id"))
    d = table("part").select("p_partkey", N.normalize_objects(objects)["bbox"][0].alias("b"))
    return d.select("p_partkey", *[F.col("b")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT doc_id, lang AS images, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang END AS rejected_images FROM documents")
def prj11_inherit_rejected(table):
    own = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return N.inherit_rejected(table("documents").select("doc_id", F.col("lang").alias("images"), own.alias("rejected_images"))).select("doc_id", "images", "rejected_images")


_TURNS = "(SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, coalesce(max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id), -1) AS last_user, max(turn) OVER (PARTITION BY conv_id) AS last, arg_min(role, turn) OVER (PARTITION BY conv_id) AS lead FROM conversations)"
_SPOKEN = "string_agg(role || ':' || text, '|' ORDER BY turn)"


@query(f"SELECT conv_id, md5(coalesce({_SPOKEN} FILTER (turn <= last_user) || '|', '') || 'assistant:no') AS messages FROM {_TURNS} GROUP BY conv_id")
def prj12_rejected_messages(table):
    return conversations(table).select("conv_id", told(N.rejected_messages(F.col("messages"), F.lit("no"))).alias("messages"))


@query(f"SELECT conv_id, max(text) FILTER (i = 0 AND role = 'system') AS system, md5(coalesce({_SPOKEN} FILTER (i > 0 OR role <> 'system'), '')) AS messages FROM {_TURNS} GROUP BY conv_id")
def prj13_split_system(table):
    d = conversations(table).select("conv_id", N.split_system(F.col("messages")).alias("p"))
    return d.select("conv_id", "p.system", told("p.messages").alias("messages"))


# ---------------------------------------------------------------- filters


@query("SELECT conv_id, last_text <> 'same' AND conv_id % 3 <> 0 AS valid FROM (SELECT conv_id, arg_max(text, turn) AS last_text FROM conversations GROUP BY conv_id)")
def flt02_preference_validity(table):
    """A null rejected response, and one that equals the chosen one, aren't valid."""
    last = F.element_at("messages", -1)["content"]
    rejected = F.when(F.col("conv_id") % 3 == 0, F.when(F.col("conv_id") % 2 == 0, last)).otherwise(F.concat(last, F.lit(" or not")))
    return conversations(table).select("conv_id", V.valid_rejected(rejected, F.col("messages")).alias("valid"))


@query("SELECT doc_id FROM documents WHERE greatest(n_chars, length(lang) * 100) <= 1500")
def flt04_within_length(table):
    return table("documents").where(V.within_length(F.array("n_chars", F.length("lang").cast("bigint") * 100), 1500)).select("doc_id")


@query("""WITH d AS (SELECT doc_id, n_chars < 2000 AS ok FROM documents),
pool AS (SELECT doc_id AS source, row_number() OVER (ORDER BY md5(concat(doc_id, '-42')), doc_id) - 1 AS at, count(*) OVER () AS total FROM d WHERE ok),
failed AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, '-43')), doc_id) - 1 AS f FROM d WHERE NOT ok)
SELECT doc_id, doc_id AS source FROM d WHERE ok UNION ALL SELECT f.doc_id, p.source FROM failed f JOIN pool p ON f.f % p.total = p.at""")
def flt06_replace_failures(table):
    return V.replace_failures(table("documents").select("doc_id", "n_chars"), F.col("n_chars") < 2000, "doc_id").select("doc_id", "source")


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase') AND event_type <> 'purchase'")
def flt08_kinds(table):
    return X.kinds(table("events"), "event_type", ["click", "purchase"], ["purchase"]).select("event_id")


@query(f"SELECT label, {said(('user', 'lang'))} AS anchor, {said(('user', 'source'))} AS positive FROM (SELECT (doc_id % 11)::DOUBLE AS label, lang, source FROM documents) WHERE label >= 6")
def flt09_similarity_threshold(table):
    d = X.sentence_pair(table("documents").select(F.col("lang").alias("sentence1"), F.col("source").alias("sentence2"), (F.col("doc_id") % 11).alias("score")), 6)
    return d.select("label", told("messages").alias("anchor"), told(F.col("positive_messages")[0]).alias("positive"))


@query("SELECT conv_id FROM conversations GROUP BY conv_id HAVING bool_or(lower(text) LIKE '%the th%')")
def flt10_mentions(table):
    return conversations(table).where(V.mentions(F.col("messages"), "the th")).select("conv_id")


@query(r"SELECT page_id, len(list_distinct(regexp_extract_all(html, '<[a-z]+')))::INTEGER AS tags FROM pages")
def flt11_distinct_matches(table):
    return table("pages").select("page_id", V.distinct_matches(F.col("html"), "<[a-z]+").alias("tags"))


@query("SELECT user_id, bool_or(starts < ends) AS overlap FROM (SELECT user_id, event_id AS starts, lag(event_id + 40 + event_id % 7) OVER (PARTITION BY user_id ORDER BY event_id) AS ends FROM events) GROUP BY user_id HAVING count(*) > 1")
def flt12_overlaps(table):
    spans = F.collect_list(F.struct(F.col("event_id").alias("start"), (F.col("event_id") + 40 + F.col("event_id") % 7).alias("end")))
    return table("events").groupBy("user_id").agg(spans.alias("s")).where(F.size("s") > 1).select("user_id", V.has_overlap(F.col("s")).alias("overlap"))


@query("SELECT page_id FROM pages WHERE url IN (SELECT url FROM pages WHERE page_id % 4 = 0)")
def flt13_existing_media(table):
    pages = table("pages")
    return V.with_existing_media(pages, "url", pages.where("page_id % 4 = 0").select(F.col("url").alias("path"))).select("page_id")


# ---------------------------------------------------------------- layouts


@query(f"SELECT doc_id, (doc_id % 5) AS label, {said(('user', 'lang'))} AS messages FROM documents WHERE doc_id % 5 <> 4")
def nrm05_classification(table):
    """Labels that aren't whole numbers drop the row."""
    label = F.when(F.col("doc_id") % 5 == 4, "none").otherwise((F.col("doc_id") % 5).cast("string"))
    d = N.classification(table("documents").select("doc_id", F.col("lang").alias("query"), label.alias("label")))
    return d.select("doc_id", "label", told("messages").alias("messages"))


@query(f"SELECT doc_id AS id, {said(('user', f'lang || {NL} || source'), ('assistant', 'text'))} AS messages FROM documents UNION ALL SELECT item_id, {said(('user', 'text'))} FROM benchmark UNION ALL SELECT conv_id, md5({_SPOKEN}) FROM conversations GROUP BY conv_id")
def nrm06_auto(table):
    """Each layout is told by its columns."""
    alpaca = N.auto(table("documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("instruction"), F.col("source").alias("input"), F.col("text").alias("output")))
    plain = N.auto(table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question")))
    chats = N.auto(messages_of(table).withColumnRenamed("messages", "conversation").withColumnRenamed("conv_id", "id"))
    return alpaca.select("id", "messages").union(plain.select("id", "messages")).union(chats.select("id", "messages")).select("id", told("messages").alias("messages"))


@query(f"SELECT doc_id, {said(('user', chr(39) + 'Name the language: ' + chr(39) + ' || lang || ' + chr(39) + '?' + chr(39)), ('assistant', 'source'))} AS messages FROM documents")
def nrm07_prompt_template(table):
    d = N.text_generation(table("documents").select("doc_id", F.col("lang").alias("query"), F.col("source").alias("response")), "Name the language: {{QUERY}}?")
    return d.select("doc_id", told("messages").alias("messages"))


@query(f"SELECT conv_id, md5(coalesce({_SPOKEN} FILTER (turn < last OR role <> 'assistant'), '')) AS messages, max(text) FILTER (turn = last AND role = 'assistant') AS label FROM {_TURNS} GROUP BY conv_id")
def nrm11_remove_response(table):
    d = conversations(table).select("conv_id", N.remove_response(F.col("messages")).alias("p"))
    return d.select("conv_id", told("p.messages").alias("messages"), "p.label")


@query(f"""SELECT conv_id, md5(coalesce(string_agg(role || ':' || CASE WHEN turn = last_user AND conv_id % 2 = 0 THEN 'Teach' ELSE text END, '|' ORDER BY turn) FILTER (conv_id % 2 = 1 OR turn < last OR role <> 'assistant'), '')) AS messages FROM {_TURNS} GROUP BY conv_id""")
def nrm13_teacher_messages(table):
    return conversations(table).select("conv_id", told(N.teacher_messages(F.col("messages"), F.when(F.col("conv_id") % 2 == 0, "Teach"))).alias("messages"))


# ---------------------------------------------------------------- text transforms


@query(f"SELECT doc_id, {said(('user', f'lang || {NL} || source'), ('assistant', 'text'))} AS messages FROM documents")
def txt01_alpaca_zh(table):
    docs = table("documents").select("doc_id", F.col("lang").alias("instruction"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("输入："), "source")).otherwise(F.col("source")).alias("input"), F.col("text").alias("output"))
    return X.alpaca_zh(docs).select("doc_id", told("messages").alias("messages"))


@query(f"SELECT doc_id, {said(('user', 'lang'), ('assistant', 'CASE WHEN doc_id % 2 = 0 THEN ' + STRIP.format('text') + ' ELSE text END'))} AS messages FROM documents")
def txt02_long_alpaca(table):
    out = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Answer: "), "text", F.lit(" \n"))).otherwise(F.col("text"))
    return X.long_alpaca(table("documents").select("doc_id", F.col("lang").alias("instruction"), out.alias("output"))).select("doc_id", told("messages").alias("messages"))


_TITLED = "CASE WHEN doc_id % 3 = 0 THEN source || ' ' || doc_id || '. ' || lang ELSE source || '，' || lang || ' 7、' || source END"


_REST = rf"CASE WHEN regexp_matches({_TITLED}, '[0-9]+[\s.,、].') THEN regexp_extract({_TITLED}, '[0-9]+[\s.,、](.+)', 1) ELSE {_TITLED} END"


@query(f"SELECT {said(('assistant', _REST))} AS messages FROM documents")
def txt03_titled_abstract(table):
    third = F.col("doc_id") % 3 == 0
    docs = table("documents").select(F.when(third, F.concat("source", F.lit(" "), "doc_id", F.lit(". "), "lang")).otherwise(F.col("source")).alias("title"), F.when(~third, F.concat("lang", F.lit(" 7、"), "source")).otherwise("").alias("abs"))
    return X.titled_abstract(docs).select(told("messages").alias("messages"))


@query(f"SELECT {said(('user', f'{chr(39)}Sql Table information:{chr(39)} || {NL} || lang || {NL} || source'), ('assistant', f'{chr(39)}Let{chr(39) * 2}s think step by step:{chr(39)} || {NL} || text || {NL} || {chr(39)}So the final sql is:{chr(39)} || {NL} || doc_id'))} AS messages FROM documents")
def txt05_text_to_sql(table):
    d = table("documents").select(F.col("lang").alias("sql_context"), F.col("source").alias("sql_prompt"), F.col("text").alias("sql_explanation"), F.col("doc_id").cast("string").alias("sql"))
    return X.text_to_sql(d).select(told("messages").alias("messages"))


@query(f"SELECT conv_id, md5(string_agg(CASE WHEN role = 'system' THEN 'assistant' ELSE role END || ':' || text, '|' ORDER BY turn)) AS messages FROM conversations GROUP BY conv_id HAVING count(*) = 2")
def txt06_two_turns(table):
    renamed = F.transform("messages", lambda m: F.struct(F.when(m["role"] == "system", "caller").otherwise(m["role"]).alias("from"), m["content"].alias("value")))
    d = X.two_turns(messages_of(table).select("conv_id", renamed.alias("conversations")))
    return d.select("conv_id", told("messages").alias("messages"))


@query(f"SELECT {said(('user', 'text'), ('assistant', f'lang || {NL} || {NL} || {chr(39)}Answer: {chr(39)} || source'))} AS messages FROM documents")
def txt07_math_with_answer(table):
    return X.math_with_answer(table("documents").select(F.col("text").alias("input"), F.col("lang").alias("output"), F.col("source").alias("answer"))).select(told("messages").alias("messages"))


@query(f"SELECT {said(('assistant', f'CASE WHEN doc_id % 2 = 0 THEN lang || {NL} ELSE {chr(39) * 2} END || source || {NL} || {chr(39)}one{chr(39)} || {NL} || {chr(39)}two{chr(39)} || {NL} || {chr(39)}end{chr(39)} || {NL}'))} AS messages FROM documents")
def txt08_law_text(table):
    d = table("documents").select(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("type"), F.col("source").alias("title"), F.lit("one").alias("chapter1"), F.lit("two").alias("chapter2"), F.lit(None).cast("string").alias("chapter3"), F.lit("end").alias("response"))
    return X.law_text(d).select(told("messages").alias("messages"))


@query(f"SELECT {said(('user', 'lang'), ('assistant', f'source || {NL} || {NL} || {chr(39)}```python{chr(39)} || {NL} || text'))} AS messages FROM documents WHERE doc_id % 4 <> 0")
def txt09_code_problem(table):
    whole = F.concat(F.lit("# "), "lang", F.lit("\n"), F.when(F.col("doc_id") % 4 == 0, F.lit("no code")).otherwise(F.concat(F.lit("```python\n"), "text")))
    d = table("documents").where("doc_id % 4 <> 0 OR NOT contains(text, '```python')").select(whole.alias("code_with_problem"), F.col("source").alias("explanation_only"))
    return X.code_problem(d).select(told("messages").alias("messages"))


@listed("positives negatives", f"SELECT {said(('user', 'query'))} AS messages, [{said(('assistant', 'a'))}] AS positives, [{said(('assistant', 'b'))}, {said(('assistant', 'c'))}] AS negatives FROM (SELECT text AS query, lang AS a, source AS b, lang || source AS c FROM documents)")
def txt11_rerank(table):
    d = X.rerank(table("documents").select(F.col("text").alias("query"), F.col("lang").alias("positive"), F.array("source", F.concat("lang", "source")).alias("negative")))
    return d.select(told("messages").alias("messages"), F.transform("positive_messages", told).alias("positives"), F.transform("negative_messages", told).alias("negatives"))


@query(f"SELECT target, {said(('user', f'{chr(39)}Using the numbers [{chr(39)} || p_size || {chr(39)}, {chr(39)} || p_partkey || {chr(39)}], create an equation that equals {chr(39)} || target || {chr(39)}. You can use basic arithmetic operations (+, -, *, /) and each number can only be used once.{chr(39)}'))} AS messages FROM (SELECT *, p_size + p_partkey AS target FROM part)")
def txt14_countdown_prompt(table):
    d = X.countdown(table("part").select(F.array(F.col("p_size").cast("bigint"), F.col("p_partkey")).alias("nums"), (F.col("p_size") + F.col("p_partkey")).alias("target")))
    return d.select("target", told("messages").alias("messages"))


@query(f"""SELECT id, label, {said(('user', 'answer'))} AS messages FROM (
SELECT doc_id AS id, 0 AS label, CASE WHEN ('0x' || substr(md5(concat(doc_id, '-42')), 1, 8))::BIGINT % 2 = 0 THEN lang ELSE source END AS answer FROM documents UNION ALL SELECT doc_id, 1, text FROM documents)""")
def txt15_answers_by_source(table):
    docs = table("documents").select(F.col("doc_id").alias("id"), F.lit("?").alias("question"), F.array("lang", "source").alias("human_answers"), F.array("text").alias("machine_answers"))
    return X.answers_by_source(docs, label=True).select("id", "label", told("messages").alias("messages"))


@query(f"SELECT {said(('user', f'{chr(39)}Task: Question Generation{chr(39)} || {NL} || {chr(39)}Context: {chr(39)} || source || {NL} || {chr(39)}Answer: {chr(39)} || lang || {NL} || {chr(39)}Question:{chr(39)}'), ('assistant', 'text'))} AS messages FROM documents WHERE doc_id % 5 <> 0")
def txt16_question_generation(table):
    both = F.concat("lang", F.when(F.col("doc_id") % 5 == 0, F.lit(" ")).otherwise(F.lit("[SEP]")), "source")
    return X.answer_context(table("documents").select(both.alias("text1"), F.col("text").alias("text2"))).select(told("messages").alias("messages"))


@query(f"SELECT {said(('user', 'lang'), ('assistant', 'source'))} AS messages, {said(('user', 'lang'), ('assistant', STRIP.format('text')))} AS rejected FROM documents")
def txt17_dialogue_preference(table):
    talk = lambda c: F.concat(F.lit("\n\nHuman: "), "lang", F.lit("\n\nAssistant: "), c)
    d = X.dialogue_preference(table("documents").select(talk(F.col("source")).alias("chosen"), talk(F.col("text")).alias("rejected")))
    return d.select(told("messages").alias("messages"), told("rejected_messages").alias("rejected"))


@query(f"""SELECT {said(('user', 'event_type'), ('tool_call', "'{" + '"name":"f","arguments":{"k":"' + "' || regexp_extract(props, '[0-9]+') || '" + '"}}' + "'"))} AS messages, props AS tools FROM events""")
def txt18_function_calls(table):
    d = table("events").select(F.col("event_type").alias("query"), F.concat(F.lit('[{"name": "f", "arguments": '), "props", F.lit("}]")).alias("answers"), F.col("props").alias("tools"))
    return X.function_calls(d).select(told("messages").alias("messages"), "tools")


@query(f"SELECT doc_id, {said(('user', 'lang'), ('assistant', 'source'))} AS messages, text AS rejected_response FROM documents")
def txt20_variation_selectors(table):
    d = table("documents").select("doc_id", F.concat("lang", F.lit("️")).alias("prompt"), F.concat(F.lit("️"), "source").alias("chosen"), F.col("text").alias("rejected"))
    return X.without_variation_selectors(d).select("doc_id", told("messages").alias("messages"), "rejected_response")


@query(f"SELECT {said(('user', f'CASE WHEN doc_id % 3 = 0 THEN {chr(39)}Here gives some useful information:{chr(39)} || {NL} || source || {NL} || lang ELSE lang END'), ('assistant', 'text'))} AS messages FROM documents")
def txt23_context_instruction(table):
    d = table("documents").select(F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, "").alias("context"), F.col("lang").alias("instruction"), F.col("text").alias("response"))
    return X.context_instruction(d).select(told("messages").alias("messages"))


@query(f"SELECT {said(('user', f'{chr(39)}Who is {chr(39)} || CASE WHEN doc_id % 2 = 0 THEN {chr(39)}甲{chr(39)} ELSE {chr(39)}Ada{chr(39)} END || {chr(39)}? {chr(39)} || lang || {chr(39)} /no_think{chr(39)}'), ('assistant', f'{chr(39)}By {chr(39)} || CASE WHEN doc_id % 2 = 0 THEN {chr(39)}乙{chr(39)} ELSE {chr(39)}Bob{chr(39)} END || source'))} AS messages FROM documents")
def txt24_identity(table):
    d = table("documents").select(F.concat(F.lit("Who is {{NAME}}? "), "lang").alias("query"), F.concat(F.lit("{{AUTHOR}}"), "source").alias("response"), F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("en").alias("tag"))
    return X.identity(d, ("甲", "Ada"), ("乙", "Bob"), " /no_think", "By ").select(told("messages").alias("messages"))


@query(f"SELECT {said(('user', f'{chr(39)}Task: Based on the given two sentences, provide a similarity score between 0.0 and 1.0.{chr(39)} || {NL} || {chr(39)}Sentence 1: {chr(39)} || lang || {NL} || {chr(39)}Sentence 2: {chr(39)} || source || {NL} || {chr(39)}Similarity score: {chr(39)}'), ('assistant', f'printf({chr(39)}%.1f{chr(39)}, (doc_id % 11) / 10.0::DOUBLE)'))} AS messages FROM documents")
def txt10_sentence_pair_generation(table):
    d = X.sentence_pair_generation(table("documents").select(F.col("lang").alias("sentence1"), F.col("source").alias("sentence2"), (F.col("doc_id") % 11 / 10).alias("score")))
    return d.select(told("messages").alias("messages"))


# ---------------------------------------------------------------- multimodal rows


@query(f"SELECT url AS path, {said(('user', chr(39) + 'What is the description of this image?' + chr(39)), ('assistant', 'url'))} AS messages FROM pages")
def mm01_caption(table):
    d = X.caption(table("pages").select(F.col("url").alias("image"), F.concat(F.lit(" "), F.regexp_replace("url", "&&", "&"), F.lit(" && more")).alias("caption")))
    return d.select(F.col("images")[0]["path"].alias("path"), told("messages").alias("messages"))


@query(f"SELECT url AS path, {said(('user', f'CASE ({chr(39)}0x{chr(39)} || substr(md5(concat(page_id, {chr(39)}-42{chr(39)})), 1, 8))::BIGINT % 3 WHEN 0 THEN {chr(39)}a{chr(39)} WHEN 1 THEN {chr(39)}b{chr(39)} ELSE {chr(39)}c{chr(39)} END'), ('assistant', 'page_id::VARCHAR'))} AS messages FROM pages")
def mm02_prompted_caption(table):
    d = X.caption(table("pages").select("page_id", F.col("url").alias("image"), F.col("page_id").cast("string").alias("caption")), prompts=("a", "b", "c"), key="page_id")
    return d.select(F.col("images")[0]["path"].alias("path"), told("messages").alias("messages"))


@query(f"SELECT lang AS audio, {said(('user', chr(39) + 'Transcribe the audio.' + chr(39)), ('assistant', f'replace(text, {chr(39)} {chr(39)}, {chr(39) * 2})'))} AS messages FROM documents")
def mm04_transcript(table):
    d = X.transcript(table("documents").select(F.col("lang").alias("audio"), "text"))
    return d.select(F.col("audios")[0].alias("audio"), told("messages").alias("messages"))


@query(f"SELECT {said(('user', f'lang || {NL} || source || {NL} || doc_id'), ('assistant', 'chr((65 + doc_id % 4)::INTEGER)'))} AS messages FROM documents")
def mm05_options(table):
    d = X.options(table("documents").select(F.col("lang").alias("question"), F.array("source", F.col("doc_id").cast("string")).alias("options"), (F.col("doc_id") % 4).alias("answer")))
    return d.select(told("messages").alias("messages"))


@listed("box", "SELECT p_name AS ref, [round_even(p_size + 0.5, 0), round_even(p_retailprice, 0)] AS box FROM part")
def mm09_referring_boxes(table):
    d = X.referring_boxes(table("part").select(F.col("p_name").alias("caption"), F.array(F.col("p_size") + F.lit(0.5).cast("double"), F.col("p_retailprice")).alias("bbox")))
    return d.select(F.col("objects.ref")[0].alias("ref"), F.col("objects.bbox")[0].alias("box"))


@listed("ref", f"SELECT [CASE p_size % 2 WHEN 0 THEN 'cat' ELSE 'dog' END, 'cat'] AS ref, {said(('user', chr(39) + 'detect' + chr(39)), ('assistant', f'{chr(39)}<ref-object><bbox>{chr(39)} || {NL} || {chr(39)}<ref-object><bbox>{chr(39)}'))} AS messages FROM part")
def mm12_detections(table):
    d = X.detections(table("part").select(F.array((F.col("p_size") % 2).cast("bigint"), F.lit(0).cast("bigint")).alias("category"), F.array(F.array(F.lit(1.0), F.lit(2.0))).alias("bbox")), ["cat", "dog"])
    return d.select("objects.ref", told("messages").alias("messages"))


@query("SELECT conv_id, md5(string_agg(CASE WHEN turn % 3 = 1 THEN '<image>' ELSE text END, '' ORDER BY turn)) AS content FROM conversations GROUP BY conv_id")
def mm13_content_parts(table):
    parts = F.transform("messages", lambda m, i: F.struct(F.when(i % 3 == 1, "image_url").otherwise("text").alias("type"), m["content"].alias("text")))
    return messages_of(table).select("conv_id", F.md5(N.flatten_parts(parts)).alias("content"))


@query(f"SELECT {said(('user', f'lang || {NL} || {chr(39)}yes{chr(39)} || {NL} || {chr(39)}no{chr(39)}'), ('assistant', f'source || {NL} || {chr(39)}So the final answer is: {chr(39)} || CASE doc_id % 2 WHEN 0 THEN {chr(39)}yes{chr(39)} ELSE {chr(39)}no{chr(39)} END'))} AS messages FROM documents")
def mm11_solution_choice(table):
    d = X.solution_choice(table("documents").select(F.col("lang").alias("question"), F.array(F.lit("yes"), F.lit("no")).alias("choices"), F.col("source").alias("solution"), (F.col("doc_id") % 2).alias("answer")))
    return d.select(told("messages").alias("messages"))


@listed("label", "SELECT doc_id, list_filter([0, 1, 2], lambda i: (doc_id // (1 << i)) % 2 = 1) AS label FROM documents")
def mm15_multi_label(table):
    bits = F.array(*[F.floor(F.col("doc_id") / (1 << i)) % 2 for i in range(3)])
    return X.multi_label(table("documents").select("doc_id", bits.alias("npy"))).select("doc_id", "label")


# ---------------------------------------------------------------- sets, joins, windows


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents QUALIFY batch < (SELECT count(*) // 64 FROM documents) AND batch >= 2")
def set13_batches(table):
    """Whole batches of 64, the first two skipped on resume."""
    return O.skip_batches(O.batches(table("documents").select("doc_id"), 64, "doc_id", drop_last=True), 2).select("doc_id", "batch")


@query("SELECT 'steps' AS name, greatest(ceil(2.5 * greatest(count(*) // (4 * 2 * 8), 1)), 1)::INTEGER AS n FROM documents")
def set24_step_count(table):
    docs = table("documents")
    return docs.sparkSession.createDataFrame([("steps", O.max_steps(docs.count(), 4, 2, 8, 2.5))], "name string, n int")


@query("SELECT event_id, ('0x' || substr(md5(concat(event_id + 42, '-0')), 1, 8))::BIGINT / 4294967296.0 < 0.3 AS first FROM events")
def set25_step_source(table):
    return table("events").select("event_id", O.step_source(F.col("event_id"), 42, 0.3).alias("first"))


@query("SELECT event_id, user_id, first_value(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS input FROM events")
def jon01_outputs_to_inputs(table):
    e = table("events")
    return S.outputs_to_inputs(e.select("user_id", "event_id", F.col("event_type").alias("input")).withColumnRenamed("event_id", "at"), e.select("event_id", "user_id"), "user_id", "at").select("event_id", "user_id", "input")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY event_id) AS items FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 90) GROUP BY user_id")
def jon03_trajectories(table):
    e = table("events")
    d = S.trajectories(e, e.where("value > 90"), "user_id", "event_id", ["event_type"])
    return d.select("user_id", F.array_join(F.transform("items", lambda x: x["event_type"]), ",").alias("items"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 3 ELSE 0 END AS n FROM events")
def jon08_consistent_logps(table):
    masks = F.array(F.array(F.lit(1), F.lit(0), F.lit(1)), F.array(F.lit(1)))
    given = F.array(F.array("value", "value"), F.when(F.col("event_id") % 3 == 0, F.array("value")).otherwise(F.array().cast("array<double>")))
    return table("events").select("event_id", F.size(F.flatten(S.consistent_logps(masks, given))).alias("n"))


@query("SELECT p_partkey, array_to_string(range(0, p_size) || range(0, p_partkey % 4), ',') AS positions FROM part")
def win09_position_ids(table):
    return table("part").select("p_partkey", F.array_join(W.position_ids(F.array(F.col("p_size").cast("bigint"), F.lit(0).cast("bigint"), F.col("p_partkey") % 4)), ",").alias("positions"))


@query("SELECT conv_id, string_agg(role || '<' || before, ',' ORDER BY turn) FILTER (before IS NOT NULL) AS pairs FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) GROUP BY conv_id HAVING count(*) > 1")
def win11_shifted_pairs(table):
    roles, texts = F.transform("messages", lambda m: m["role"]), F.transform("messages", lambda m: m["content"])
    d = conversations(table).where(F.size("messages") > 1).select("conv_id", W.shifted_pairs(roles, texts).alias("p"))
    return d.select("conv_id", F.array_join(F.transform("p", lambda x: F.concat(x["label"], F.lit("<"), x["pred"])), ",").alias("pairs"))


# ---------------------------------------------------------------- aggregates and metrics


@query("SELECT event_type, round(coalesce(avg(CASE WHEN value > 50 THEN value END), -1), 4) AS mean FROM events GROUP BY event_type")
def agg02_mean_metric(table):
    e = table("events").withColumn("high", F.when(F.col("value") > 50, F.col("value")))
    return e.groupBy("event_type").agg(r(M.mean_metric("high", -1.0)).alias("mean"))


@query("SELECT sum(p) AS prompt_tokens, sum(g) AS generated_tokens, count(*) AS samples, round(count(*) / 20, 4) AS samples_per_s, round(sum(g) / 20, 4) AS tokens_per_s FROM (SELECT user_id, max(event_id) AS p, arg_max(length(props), event_id) AS g FROM events GROUP BY user_id)")
def agg03_inference_stats(table):
    e = table("events").select("user_id", "event_id", F.col("event_id").alias("prompt_tokens"), F.length("props").alias("generated_tokens"))
    d = M.inference_stats(e, "user_id", "event_id", 20.0)
    return d.select("prompt_tokens", "generated_tokens", "samples", r(F.col("samples_per_s")).alias("samples_per_s"), r(F.col("tokens_per_s")).alias("tokens_per_s"))


@query("SELECT round(sum(CASE WHEN value > 50 AND event_id % 4 = 0 THEN 1 ELSE 0 END) / sum(CASE WHEN value > 50 THEN 1 ELSE 0 END), 6) AS token, round(avg(CASE WHEN value <= 50 OR event_id % 4 = 0 THEN 1.0 ELSE 0 END), 6) AS sequence FROM events")
def met01_token_accuracy(table):
    """A token at most 50 is ignored; of the others every fourth is right."""
    pair = F.array(F.struct(F.when(F.col("value") > 50, 7).otherwise(-100).alias("label"), F.when(F.col("event_id") % 4 == 0, 7).otherwise(1).alias("pred")))
    e = table("events").withColumn("pairs", pair)
    return M.token_accuracy(e, "pairs").select(r(F.col("acc"), 6).alias("token")).crossJoin(M.token_accuracy(e, "pairs", "sequence").select(r(F.col("acc"), 6).alias("sequence")))


@query("SELECT round(avg(CASE WHEN (value > 50) = (event_id % 2 = 0) AND (value > 20) = (event_id % 3 = 0) THEN 1.0 ELSE 0 END), 6) AS acc FROM events")
def met02_multilabel_accuracy(table):
    e = table("events").select(F.array(F.col("value") - 50, F.col("value") - 20).alias("logits"), F.array((F.col("event_id") % 2 == 0).cast("int"), (F.col("event_id") % 3 == 0).cast("int")).alias("labels"))
    return M.multilabel_accuracy(e, "logits", "labels").select(r(F.col("acc"), 6).alias("acc"))


@query("""SELECT round(avg(ln(total) - p / 100), 4) AS loss FROM (SELECT user_id, sum(exp(value / 100)) AS total, max(p) AS p FROM (
SELECT *, max(CASE WHEN event_id = f THEN value END) OVER (PARTITION BY user_id) AS p FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)) WHERE event_id = f OR value <= p + 10 GROUP BY user_id)""")
def met10_infonce_loss(table):
    """The first event of a user is the positive; scores more than 10 above it are false negatives."""
    e = table("events")
    first = e.groupBy("user_id").agg(F.min("event_id").alias("first"))
    e = e.join(first, "user_id").withColumn("positive", (F.col("event_id") == F.col("first")).cast("int"))
    return M.infonce_loss(e, "user_id", "positive", "value", 100.0, 10.0).select(r(F.col("loss")).alias("loss"))


_PAIRED = "(SELECT (a.label = b.label)::INTEGER AS y, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[]) * list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS c FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


@query(f"""WITH p AS (SELECT *, 1 - c AS d FROM {_PAIRED}), e AS (SELECT max(d) FILTER (y = 1) AS far, min(d) FILTER (y = 0) AS near FROM p)
SELECT round(avg((c - y) ** 2), 4) AS cosine, round(avg(0.5 * (y * d * d + (1 - y) * greatest(0.5 - d, 0) ** 2)), 4) AS contrastive,
round(sum(CASE WHEN y = 0 AND d < far THEN greatest(0.5 - d, 0) ** 2 WHEN y = 1 AND d > near THEN d * d ELSE 0 END), 3) AS online FROM p, e""")
def met11_pair_losses(table):
    v = table("embeddings")
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"), F.col("label").alias("label_b"))
    pairs = v.join(other, "vec_id").select(F.col("embedding").alias("a"), "b", (F.col("label") == F.col("label_b")).cast("int").alias("y"))
    return M.pair_losses(pairs, "a", "b", "y").select(r(F.col("cosine")).alias("cosine"), r(F.col("contrastive")).alias("contrastive"), r(F.col("online"), 3).alias("online"))


@listed("values", "SELECT min(event_type) AS name, any_value(x) AS values FROM (SELECT 'best' AS event_type, [round(min(value), 4), round(max(value), 4), count(*)::DOUBLE] AS x FROM events)")
def agg05_flattened_metrics(table):
    """Metrics of several values by name; those that are null are dropped."""
    row = table("events").agg(F.min("value"), F.max("value"), F.count(F.lit(1))).first()
    flat = M.flatten_metrics({"value": {"low": row[0], "high": row[1], "none": None}, "n": float(row[2])})
    return table("events").sparkSession.createDataFrame([("best", [round(flat["value_low"], 4), round(flat["value_high"], 4), flat["n"]])], "name string, values array<double>")


@query("""WITH t AS (SELECT user_id AS k, value / 50 AS s, (event_id % 7)::DOUBLE AS t FROM events),
z AS (SELECT k, ln(sum(exp(s))) AS zs, ln(sum(exp(t))) AS zt FROM t GROUP BY k),
l AS (SELECT k, s - zs AS ls, t - zt AS lt FROM t JOIN z USING (k)),
m AS (SELECT *, ln(0.5 * exp(ls) + 0.5 * exp(lt)) AS mix FROM l)
SELECT round(avg(d), 5) AS jsd FROM (SELECT k, sum(0.5 * exp(lt) * (lt - mix) + 0.5 * exp(ls) * (ls - mix)) AS d FROM m GROUP BY k)""")
def met15_jensen_shannon(table):
    e = table("events").select("user_id", "event_id", (F.col("value") / 50).alias("s"), (F.col("event_id") % 7).cast("double").alias("t"))
    return M.jensen_shannon(e, "user_id", "event_id", "s", "t").select(r(F.col("jsd"), 5).alias("jsd"))


@query("SELECT event_id, round(exp(-x) * x, 6) AS dft, round(exp(-x) * (1 - exp(-x)) * x, 6) AS chord, round(0.75 * y + 0.25 * x, 6) AS mixed FROM (SELECT event_id, value / 41 AS x, (event_id % 5)::DOUBLE AS y FROM events)")
def met16_token_losses(table):
    made = M.token_loss_variants(F.col("value") / 41, (F.col("event_id") % 5).cast("double"), 0.25)
    return table("events").select("event_id", *[r(made[k], 6).alias(k) for k in ("dft", "chord", "mixed")])


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS grp FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY user_id, grp ORDER BY event_id) - 1 AS place FROM g WHERE grp > 0)
SELECT user_id, grp, place::INTEGER AS pred, 0 AS target FROM p QUALIFY row_number() OVER (PARTITION BY user_id, grp ORDER BY value DESC, place) = 1""")
def met17_listwise_predictions(table):
    e = table("events").withColumn("label", (F.col("event_type") == "purchase").cast("int"))
    return M.listwise_predictions(e, "value", "label", "event_id", ["user_id"])


@query("SELECT event_id, event_type FROM events WHERE value IS NOT NULL AND event_id % 2 = 0 ORDER BY event_id DESC LIMIT 25")
def met18_completion_log(table):
    e = table("events").withColumn("half", F.when(F.col("event_id") % 2 == 0, F.col("value")))
    return M.completion_log(e, "event_id", ["value", "half"], 25).select("event_id", "event_type")


@query("SELECT event_id, value = min(value) OVER () AS best_loss, length(props) = min(length(props)) OVER () AS best_metric, user_id = max(user_id) OVER () AS best_score FROM events")
def met13_best_flags(table):
    e = table("events").select("event_id", F.length("props").alias("m"), F.col("value").alias("l"), F.col("user_id").alias("s"))
    return M.best_flags(e, "m", "l", "s").select("event_id", "best_loss", "best_metric", "best_score")


# ---------------------------------------------------------------- rendering


@query("""WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 + (arg_min(role, turn) OVER (PARTITION BY conv_id) = 'assistant')::INTEGER AS j FROM conversations)
SELECT conv_id, (j // 2)::INTEGER AS i, coalesce(max(text) FILTER (j % 2 = 0), '') AS query, max(text) FILTER (j % 2 = 1) AS response FROM t GROUP BY conv_id, j // 2""")
def rnd06_std_rounds(table):
    d = conversations(table).select("conv_id", F.posexplode(R.std_rounds(F.col("messages"))).alias("i", "p"))
    return d.select("conv_id", "i", F.col("p.query").alias("query"), F.col("p.response").alias("response"))


@query(f"SELECT conv_id, md5(string_agg(role || ':' || CASE WHEN role = 'assistant' AND NOT starts_with(text, '<think>') THEN '<think></think>' ELSE '' END || text, '|' ORDER BY turn)) AS training, md5(string_agg(role || ':' || CASE WHEN role = 'assistant' AND turn > last_user AND NOT starts_with(text, '<think>') THEN '<think></think>' ELSE '' END || text, '|' ORDER BY turn)) AS serving FROM {_TURNS} GROUP BY conv_id")
def rnd10_thinking_prefix(table):
    made = [told(R.add_thinking_prefix(F.col("messages"), "<think></think>", t)).alias(n) for t, n in ((True, "training"), (False, "serving"))]
    return conversations(table).select("conv_id", *made)


@query("SELECT doc_id, 'A' || lang || 'B' || source || 'C<x>' AS text FROM documents")
def rnd13_tags_in_order(table):
    return table("documents").select("doc_id", R.replace_in_order(F.lit("A<x>B<x>C<x>"), "<x>", F.array("lang", "source")).alias("text"))


@query("SELECT doc_id, repeat('<image>', greatest(doc_id % 4 - 1, 0)::INTEGER) || '<image>' || lang AS content FROM documents")
def rnd14_default_tags(table):
    return table("documents").select("doc_id", R.default_tags(F.concat(F.lit("<image>"), "lang"), (F.col("doc_id") % 4).cast("int"), "<image>").alias("content"))


@listed("paths", "SELECT doc_id, '<image> and <image>' AS content, [lang, source] AS paths FROM documents")
def rnd15_image_paths(table):
    d = table("documents").select("doc_id", R.image_paths(F.concat(F.lit("<img>"), "lang", F.lit("</img> and <img>"), "source", F.lit("</img>"))).alias("p"))
    return d.select("doc_id", "p.content", "p.paths")


@listed("box", "SELECT p_partkey, [round_even(p_size / 640.0::DOUBLE * 1000, 0)::INTEGER, round_even(p_size / 480.0::DOUBLE * 1000, 0)::INTEGER] AS box, '[(' || p_size || ',' || p_size + 1 || '),(' || p_size + 2 || ',' || p_size + 3 || ')]' AS text FROM part")
def rnd16_boxes(table):
    size = F.col("p_size").cast("double")
    box = R.scale_boxes(F.array(F.array(size, size)), F.lit(640.0).cast("double"), F.lit(480.0).cast("double"))[0]
    return table("part").select("p_partkey", box.alias("box"), R.box_text(F.array(*[F.col("p_size") + i for i in range(4)])).alias("text"))


@listed("first second", "SELECT doc_id, [-100, -100, 3, 7, 8] AS first, CASE WHEN doc_id % 2 = 0 THEN [-100, 2, 7, 8, -100, -100] ELSE [-100, -100, -100, -100, -100, -100] END AS second FROM documents")
def rnd18_end_tokens(table):
    """The suffix 7, 8 is unmasked where it directly follows a supervised token."""
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    keep = F.when(F.col("doc_id") % 2 == 0, lits(-100, 2, -100, -100, -100, -100)).otherwise(lits(*[-100] * 6))
    d = table("documents").select("doc_id", lits(1, 7, 3, 7, 8).alias("a"), lits(-100, -100, 3, -100, -100).alias("x"), lits(1, 2, 7, 8, 7, 8).alias("b"), keep.alias("y"))
    return d.select("doc_id", R.end_tokens(F.col("a"), F.col("x"), [7, 8]).alias("first"), R.end_tokens(F.col("b"), F.col("y"), [7, 8]).alias("second"))


_WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')"


@listed("kept", f"SELECT doc_id, len(ws)::INTEGER AS n, list_transform(list_filter(range(1, len(ws) + 1), lambda i: i > 1 AND i % 2 = 0), lambda i: ws[i]) AS kept FROM (SELECT doc_id, {_WORDS} AS ws FROM documents) WHERE len(ws) > 0")
def rnd17_masked_labels(table):
    """Every other word is supervised; the first one never is."""
    d = table("documents").select("doc_id", T.words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    labels = R.masked_labels(F.transform("ws", lambda w, i: i + 1), F.transform("ws", lambda w, i: (i % 2).cast("double")))
    return d.select("doc_id", F.size("ws").alias("n"), F.transform(F.filter(labels, lambda x: x != -100), lambda i: F.get("ws", i - 1)).alias("kept"))


@listed("texts labels", "SELECT event_id, [event_type, 'a', 'n1', 'n2'] AS texts, [CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 1.0 END, 0, 0]::DOUBLE[] AS labels FROM events")
def rnd22_embedding_rows(table):
    lits = lambda *xs: F.array(*[F.lit(x) for x in xs])
    made = S.embedding_rows(F.col("event_type"), lits("a", "b"), lits("n1", "n2"), F.when(F.col("event_id") % 2 == 0, 0.5))
    return table("events").select("event_id", made.alias("p")).select("event_id", "p.texts", "p.labels")


@listed("messages labels", "SELECT event_id, [event_type || '|p', event_type || '|n', event_type || '|' || props] AS messages, [1, 0, 0] AS labels FROM events")
def rnd23_rerank_rows(table):
    made = S.rerank_rows(F.array("event_type"), F.array(F.array(F.lit("p"))), F.array(F.array(F.lit("n")), F.array("props")))
    d = table("events").select("event_id", made.alias("p"))
    return d.select("event_id", F.transform("p", lambda x: F.array_join(x["messages"], "|")).alias("messages"), F.transform("p", lambda x: x["label"]).alias("labels"))


@listed("several", "SELECT event_id, CASE WHEN value >= 50 THEN 0 ELSE 1 END AS best, list_filter([0, 1], lambda i: CASE i WHEN 0 THEN value >= 50 ELSE value <= 60 END) AS several FROM events")
def rnd24_decode_classes(table):
    v = F.col("value")
    return table("events").select("event_id", R.decode_classes(F.array(v - 50, 50 - v)).alias("best"), R.decode_classes(F.array(v - 50, 60 - v), True).alias("several"))


@listed("ids labels", "SELECT p_partkey, [1, 5, 6, 5, 6, 2] AS ids, [1, -100, -100, -100, -100, p_size] AS labels FROM part")
def rnd25_extend_tokens(table):
    made = R.extend_tokens(F.array(*[F.lit(x) for x in (1, 9, 9, 2)]), F.array(F.lit(1), F.lit(9), F.lit(9), F.col("p_size")), 9, F.array(F.lit(5), F.lit(6)))
    return table("part").select("p_partkey", made.alias("m")).select("p_partkey", "m.ids", "m.labels")


@listed("starts", f"SELECT doc_id, list_transform(list_filter(range(1, len(ws)), lambda i: ws[i] = ws[1] AND ws[i + 1] = ws[2]), lambda i: (i - 1)::INTEGER) AS starts FROM (SELECT doc_id, {_WORDS} AS ws FROM documents) WHERE len(ws) > 1")
def rnd26_find_sublists(table):
    d = table("documents").select("doc_id", T.words(F.col("text")).alias("ws")).where(F.size("ws") > 1)
    return d.select("doc_id", R.find_sublists(F.col("ws"), F.slice("ws", 1, 2)).alias("starts"))


@query("SELECT p_partkey, CASE WHEN w * h <= 200000 THEN w ELSE floor(sqrt(200000 / (w::DOUBLE / h)) * (w::DOUBLE / h)) END::INTEGER AS width, CASE WHEN w * h <= 200000 THEN h ELSE floor(sqrt(200000 / (w::DOUBLE / h))) END::INTEGER AS height FROM (SELECT p_partkey, 100 + p_size * 20 AS w, 97 + (p_partkey % 700)::INTEGER AS h FROM part)")
def rnd27_pixel_limit(table):
    d = table("part").select("p_partkey", R.pixel_limit(100 + F.col("p_size") * 20, (97 + F.col("p_partkey") % 700).cast("int"), 200000).alias("s"))
    return d.select("p_partkey", "s.width", "s.height")


@query(f"SELECT conv_id, md5(string_agg(role || ':' || CASE WHEN role = 'assistant' AND later = 0 THEN 'second' WHEN role = 'assistant' AND later = 1 THEN 'first' ELSE text END, '|' ORDER BY turn)) AS messages FROM (SELECT *, count(*) FILTER (role = 'assistant') OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) - (role = 'assistant')::INTEGER AS later FROM conversations) GROUP BY conv_id")
def rnd28_replace_responses(table):
    return conversations(table).select("conv_id", told(R.replace_responses(F.col("messages"), F.array(F.lit("first"), F.lit("second")))).alias("messages"))


@listed("weights", "SELECT doc_id, lang || 'Action:' || 'a' || 'Final Answer:' || source AS text, (CASE WHEN lang = '' THEN [2, 2, 1, 1] ELSE [1, 2, 2, 1, 1] END)::DOUBLE[] AS weights FROM documents")
def lsc03_delimiter_weights(table):
    """Delimiters and what follows them have their own weights; what leads has 1."""
    text = F.concat("lang", F.lit("Action:aFinal Answer:"), "source")
    d = table("documents").select("doc_id", R.response_weights(text, R.WEIGHT_MAPS["react"]).alias("p"))
    return d.select("doc_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"), F.transform("p", lambda x: x["weight"]).alias("weights"))


# ---------------------------------------------------------------- packing, rewards, selection, advantages


@query("""WITH w AS (SELECT event_id, user_id, range(0, (event_id % 7)::BIGINT + 1) AS ids FROM events), m AS (SELECT *, ceil(max(len(ids)) OVER (PARTITION BY user_id) / 4) * 4 AS l FROM w)
SELECT event_id, array_to_string(list_transform(range(0, l::BIGINT), lambda i: CASE WHEN i < len(ids) THEN i ELSE 99 END), ',') AS ids, array_to_string(list_transform(range(0, l::BIGINT), lambda i: CASE WHEN i < len(ids) THEN 1 ELSE 0 END), ',') AS mask FROM m""")
def pck05_collate(table):
    e = table("events").select("event_id", "user_id", F.sequence(F.lit(0).cast("bigint"), F.col("event_id") % 7).alias("ids"))
    d = P.collate(e, "user_id", "ids", {}, pad_id=99, multiple=4)
    return d.select("event_id", F.array_join("ids", ",").alias("ids"), F.array_join("attention_mask", ",").alias("mask"))


@query("SELECT doc_id, (ceil(n_chars / 16.0) * 16)::INTEGER AS padded FROM documents")
def pck07_round_up(table):
    return table("documents").select("doc_id", P.round_up(F.col("n_chars"), 16).alias("padded"))


_PACKING = """WITH RECURSIVE d AS (
  SELECT doc_id, n_chars, ((row_number() OVER (ORDER BY doc_id)) * 4 - 1) // count(*) OVER () AS shard FROM documents
), o AS (
  SELECT *, row_number() OVER (PARTITION BY shard ORDER BY n_chars DESC, doc_id) AS i FROM d
), s(shard, i, rooms, pack) AS (
  SELECT DISTINCT shard, 0::BIGINT, []::BIGINT[], NULL::BIGINT FROM o
  UNION ALL
  SELECT s.shard, o.i, CASE WHEN b IS NULL THEN list_append(rooms, 8192 - n_chars) ELSE list_concat(list_append(rooms[1:b - 1], rooms[b] - n_chars), rooms[b + 1:len(rooms)]) END,
         coalesce(b, len(rooms) + 1) - 1
  FROM s JOIN o ON o.shard = s.shard AND o.i = s.i + 1,
       LATERAL (SELECT list_max(list_filter(range(1, len(rooms) + 1), lambda k: rooms[k] = list_min(list_filter(rooms, lambda x: x >= n_chars)))) AS b)
)"""


@query(f"{_PACKING} SELECT doc_id, n_chars, s.shard::INTEGER AS shard, pack FROM s JOIN o USING (shard, i)")
def pck01_best_fit(table):
    """Longest first, each into the fullest bin that has room; over-long documents have a bin of their own."""
    return P.pack_table(table("documents"), "doc_id", "n_chars", 8192, shards=4, chunk=10**9).select("doc_id", "n_chars", "shard", "pack")


@query(f"{_PACKING} SELECT s.shard::INTEGER AS shard, pack, sum(n_chars)::BIGINT AS total, md5(string_agg(doc_id || ':' || n_chars, ',' ORDER BY s.i)) AS members FROM s JOIN o USING (shard, i) GROUP BY s.shard, pack")
def pck04_packed_rows(table):
    packed = P.pack_table(table("documents"), "doc_id", "n_chars", 8192, shards=4, chunk=10**9)
    values = table("documents").select("doc_id", F.array(F.concat_ws(":", "doc_id", "n_chars")).alias("names"), F.array("n_chars").alias("sizes"))
    d = P.packed_rows(packed.select("doc_id", "shard", "pack", "pos"), values, "doc_id", ["names", "sizes"])
    return d.select("shard", "pack", F.aggregate("sizes", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.md5(F.array_join("names", ",")).alias("members"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 0 END AS reward FROM documents")
def rwd02_react_format(table):
    third = F.col("doc_id") % 3
    text = F.concat(F.when(third == 1, F.lit("So ")).otherwise(F.lit("")), F.lit("<think>"), "text", F.lit("</think>\nAction: a\n"), F.when(third == 2, F.lit("Input")).otherwise(F.lit("Action Input: {}")))
    return table("documents").select("doc_id", RW.react_format(text).alias("reward"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 1.0::DOUBLE ELSE 0 END AS reward FROM events")
def rwd08_tool_action(table):
    """The same action with the same arguments, against another argument."""
    call = lambda args: F.concat(F.lit("Action: look\nAction Input: "), args)
    other = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.lit('{"k": -1}'))
    return table("events").select("event_id", RW.tool_action(call(other), call(F.col("props"))).alias("reward"))


@query("SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 0 ELSE (event_id % 10) / 10.0 END::DOUBLE AS judged, round(CASE WHEN event_id % 10 = 0 THEN 1 ELSE ((event_id % 10) / 10.0 + 1) / 2 END::DOUBLE, 6) AS mean FROM events")
def rwd09_judgements(table):
    text = F.when(F.col("event_id") % 10 == 0, F.lit("none")).otherwise(F.concat(F.lit("Good. Reward: 0."), F.col("event_id") % 10))
    return table("events").select("event_id", RW.judged(text).alias("judged"), r(RW.mean_judgement(F.array(text, F.lit("Reward: 1"), F.lit("?"))), 6).alias("mean"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1.0::DOUBLE ELSE 0 END AS reward FROM part")
def rwd10_countdown(table):
    """The right equation, one with another number, and one of another value."""
    third, n = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.concat(F.lit("<answer>("), n, F.when(third == 1, F.lit(" + 4")).otherwise(F.lit(" + 3")), F.when(third == 2, F.lit(") * 2 = x")).otherwise(F.lit(") - 2 = x")), F.lit("</answer>"))
    return table("part").select("p_partkey", RW.countdown(text, (F.col("p_size") + 1).cast("double"), F.array(F.col("p_size").cast("bigint"), F.lit(3).cast("bigint"), F.lit(2).cast("bigint"))).alias("reward"))


@query("""SELECT event_id, md5('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS id FROM events""")
def sel03_row_id(table):
    e = table("events")
    return e.select("event_id", S.row_id(e.select("user_id", "event_type", F.array("props").alias("choices"))).alias("id"))


@query(f"SELECT doc_id, md5('<think>' || text || '</think>' || {NL} || {NL} || '<answer>' || lang || '</answer>') AS text FROM documents")
def sel04_distilled(table):
    return table("documents").select("doc_id", F.md5(S.distilled(F.col("text"), F.col("lang"))).alias("text"))


@query("SELECT event_id, round(coalesce(CASE WHEN event_id % 3 <> 0 THEN value END, 0) * 2 + user_id * 0.5 - 0.1 * (event_id % 5), 6) AS reward FROM events")
def adv01_weighted_reward(table):
    e = table("events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.col("user_id").alias("b"), (F.col("event_id") % 5).alias("kl"))
    return e.select("event_id", r(G.weighted_reward(["a", "b"], [2.0, 0.5], "kl", 0.1), 6).alias("reward"))


@query("""WITH s AS (SELECT user_id, stddev_samp(CASE WHEN user_id % 3 = 0 THEN 1 ELSE value END) > 0 AS v FROM events GROUP BY user_id),
k AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat(user_id, '-42')), user_id) AS rn FROM s WHERE v)
SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM k WHERE rn <= 5)""")
def adv08_dynamic_sampling(table):
    e = table("events").withColumn("reward", F.when(F.col("user_id") % 3 == 0, 1.0).otherwise(F.col("value")))
    return G.dynamic_sampling(e, lambda i: e.limit(0), "reward", "user_id", 5).select("event_id")


@query("SELECT user_id, round(avg(CASE WHEN event_id % 4 <> 0 THEN value - 50 END), 6) AS gap, coalesce(avg(CASE WHEN event_id % 4 <> 0 THEN value - 50 END) > 0.5, false) AND user_id % 2 = 0 AS masked FROM events GROUP BY user_id")
def adv10_off_policy_mask(table):
    t = table("events").select("user_id", F.col("value").alias("old"), F.lit(50.0).alias("new"), (F.col("event_id") % 4 != 0).cast("int").alias("mask"), F.when(F.col("user_id") % 2 == 0, -1.0).otherwise(1.0).alias("advantage"))
    d = G.off_policy_mask(t, "old", "new", "mask", "advantage", "user_id", 0.5)
    return d.select("user_id", r(F.col("gap"), 6).alias("gap"), F.coalesce("masked", F.lit(False)).alias("masked"))


@query("SELECT round(avg(w), 6) AS mean_weight, round(sum(w) ** 2 / (count(*) * sum(w * w)), 6) AS ess, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS clipped FROM (SELECT value, least(value, 50.0) AS w FROM events WHERE event_id % 4 <> 0)")
def adv12_weight_metrics(table):
    t = table("events").select(F.col("value").alias("ratio"), F.least(F.col("value"), F.lit(50.0)).alias("w"), (F.col("event_id") % 4 != 0).cast("int").alias("mask"))
    d = G.weight_metrics(t, "w", "ratio", "mask", 50.0)
    return d.select(*[r(F.col(c), 6).alias(c) for c in ("mean_weight", "ess", "clipped")])


@query("""WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT vec_id, sum(exp(v)) AS z FROM x GROUP BY vec_id)
SELECT vec_id, round(-sum(exp(v) / z * ln(exp(v) / z)), 4) AS entropy FROM x JOIN m USING (vec_id) GROUP BY vec_id""")
def adv14_entropy(table):
    return table("embeddings").select("vec_id", r(G.entropy(F.transform("embedding", lambda v: v.cast("double")))).alias("entropy"))


# ---------------------------------------------------------------- text functions


@query(r"SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') = t AS same, md5(t) AS stripped, CASE WHEN length(text) > 100 THEN text[1:50] || '...' || text[length(text) - 49:length(text)] ELSE text END AS short FROM (SELECT *, trim(text, chr(9) || chr(10) || chr(13) || ' ') AS t FROM documents)")
def str03_strip_and_short(table):
    return table("documents").select("doc_id", (T.strip(F.col("text")) == T.strip(T.strip(F.col("text")))).alias("same"), F.md5(T.strip(F.col("text"))).alias("stripped"), T.printable(F.col("text")).alias("short"))


@query("SELECT doc_id, split_part(text, ' ', 1) AS first, list_last(string_split(text, ' ')) AS last FROM documents")
def str03_before_after(table):
    return table("documents").select("doc_id", T.before(F.col("text"), " ").alias("first"), T.after_last(F.col("text"), " ").alias("last"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'image' WHEN 1 THEN 'video' ELSE 'audio' END AS kind FROM pages")
def src19_media_type(table):
    name = F.concat("url", F.element_at(F.array(F.lit(".PNG"), F.lit(".mp4"), F.lit(".flac")), (F.col("page_id") % 3 + 1).cast("int")))
    return table("pages").select("page_id", T.media_type(name).alias("kind"))


@query("""WITH pool AS (SELECT text, row_number() OVER (ORDER BY md5(concat(text, '-42')), text) AS place, count(*) OVER () AS n FROM (SELECT DISTINCT text FROM documents)),
seats AS (SELECT doc_id, text AS own, i, (('0x' || substr(md5(concat(doc_id, '-42')), 1, 8))::BIGINT + i) % (SELECT max(n) FROM pool) + 1 AS place FROM documents, range(0, 8) AS t(i))
SELECT doc_id, md5(pool.text) AS negative, (row_number() OVER (PARTITION BY doc_id ORDER BY i))::INTEGER AS rank FROM seats JOIN pool USING (place) WHERE pool.text <> own QUALIFY rank <= 7""")
def mm07_negative_rows(table):
    """The negatives of every document, in order."""
    return S.negatives(table("documents").select("doc_id", "text"), "doc_id", "text").select("doc_id", F.md5("negative").alias("negative"), "rank")


@query("""WITH q AS (SELECT DISTINCT user_id, event_type, length(event_type) AS l FROM events), g AS (SELECT user_id, avg(l) AS m, coalesce(stddev_samp(l), 0) AS s FROM q GROUP BY user_id)
SELECT event_id, round((length(event_type) - m) / (s + 1e-4), 4) AS advantage FROM events JOIN g USING (user_id)""")
def adv06_request_advantages(table):
    """One row of each request counts in its group; all rows of a request get its advantage."""
    e = table("events").select("event_id", "user_id", F.concat_ws("-", "user_id", "event_type").alias("request"), F.length("event_type").cast("double").alias("reward"))
    return G.request_advantages(e, "reward", "user_id", "request", "event_id").select("event_id", r(F.col("advantage")).alias("advantage"))


# ---------------------------------------------------------------- operators of round two

Q = chr(39)


@query("SELECT doc_id, place, CASE place WHEN 0 THEN lang WHEN 1 THEN source END AS a, CASE place WHEN 0 THEN doc_id WHEN 1 THEN n_chars ELSE doc_id + 1 END AS b FROM documents, range(0, 3) AS t(place)")
def prj05_columns_to_rows(table):
    """Shorter arrays are padded with nulls."""
    longer = F.array("doc_id", "n_chars", F.col("doc_id") + 1)
    d = N.columns_to_rows(table("documents").select("doc_id", F.array(*[F.lit(i).cast("bigint") for i in range(3)]).alias("place"), F.array("lang", "source").alias("a"), longer.alias("b")), ["place", "a", "b"])
    return d.select("doc_id", "place", "a", "b")


@query("SELECT user_id, string_agg(coalesce(v, 'null'), ',' ORDER BY event_id) AS joined FROM (SELECT user_id, event_id, CASE WHEN event_id % 3 <> 0 THEN event_type END AS v FROM events) GROUP BY user_id")
def prj05_rows_to_columns(table):
    """Nulls keep their places."""
    e = table("events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("v"))
    d = N.rows_to_columns(e, ["user_id"], "event_id", ["v"])
    return d.select("user_id", F.array_join("v", ",", "null").alias("joined"))


@listed("labels lengths", "SELECT doc_id, [lang, source] AS labels, ['1', 'none'] AS lengths FROM documents")
def prj14_parallel_inputs(table):
    lists = F.struct(F.array("lang", "source").alias("label"), F.array(F.lit(1)).alias("length"))
    d = table("documents").select("doc_id", N.parallel_inputs(lists, ["label", "length"]).alias("p"))
    return d.select("doc_id", F.transform("p", lambda x: x["label"]).alias("labels"), F.transform("p", lambda x: F.coalesce(x["length"].cast("string"), F.lit("none"))).alias("lengths"))


@query("SELECT doc_id FROM documents WHERE n_chars <= 1000")
def flt05_drop_overlong(table):
    return V.drop_overlong(table("documents"), F.array("n_chars"), 1000).select("doc_id")


@query("""WITH d AS (SELECT doc_id, n_chars < 2000 AS ok FROM documents),
failed AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, '-43')), doc_id) - 1 AS f, count(*) OVER () AS n FROM d WHERE NOT ok),
looked AS (SELECT page_id, length(html) > 1500 AS ok, row_number() OVER (ORDER BY md5(concat(page_id, '-42')), page_id) AS rn FROM pages),
pool AS (SELECT page_id, row_number() OVER (ORDER BY rn) - 1 AS place, count(*) OVER () AS total FROM looked WHERE ok AND rn <= 10 * (SELECT max(n) FROM failed))
SELECT doc_id, doc_id AS source FROM d WHERE ok UNION ALL SELECT f.doc_id, p.page_id FROM failed f JOIN pool p ON f.f % p.total = p.place""")
def flt07_refill(table):
    """Failing documents are filled from another table."""
    backup = table("pages").select(F.col("page_id").alias("doc_id"), F.length("html").cast("bigint").alias("n_chars"))
    return V.refill(table("documents").select("doc_id", "n_chars"), F.col("n_chars") < 2000, backup, F.col("n_chars") > 1500, "doc_id").select("doc_id", "source")


@listed("mask", "SELECT event_id, CASE WHEN value > 50 THEN [0, 0, 0] ELSE [1, 0, 1] END AS mask FROM events")
def flt15_overlong_mask(table):
    return table("events").select("event_id", V.without_truncated(F.array(F.lit(1), F.lit(0), F.lit(1)), F.col("value") > 50).alias("mask"))


@query(f"SELECT doc_id, {said(('user', 'lang'), ('assistant', 'upper(source)'))} AS messages FROM {{}} WHERE rn <= 100".format("(SELECT *, row_number() OVER (ORDER BY md5(concat(doc_id, '-42')), doc_id) AS rn FROM documents)"))
def nrm01_preprocess(table):
    """An exact sample, renames, a hook on the whole table, a layout."""
    docs = table("documents").select("doc_id", F.col("lang").alias("Q"), "source")
    d = N.preprocess(docs, N.query_response, {"q": "query", "source": "response"}, 100, "doc_id", lambda t: t.withColumn("response", F.upper("response")))
    return d.select("doc_id", told("messages").alias("messages"))


@query("SELECT doc_id, i::BIGINT AS i, repeat('x', i::INTEGER) AS text FROM documents, range(0, 3) AS t(i) WHERE i < doc_id % 3")
def udx01_row_function(table):
    """No row, one or two rows for each."""
    def rows(row: dict):
        n = row["doc_id"] % 3
        made = [{"doc_id": row["doc_id"], "i": i, "text": "x" * i} for i in range(n)]
        return None if not n else made[0] if n == 1 else made

    return N.map_rows(table("documents").select("doc_id"), rows, "doc_id bigint, i bigint, text string")


_HEX = "('0x' || substr(md5(concat(doc_id, '-{}')), 1, 8))::BIGINT"


def _prompts(lang: str, side: int) -> str:
    pairs = X.GROUNDING["grounding"][lang]
    return "[" + ", ".join(f"'{p[side]}'" for p in pairs) + f"][{_HEX.format(42)} % {len(pairs)} + 1]"


@query(f"SELECT doc_id, CASE WHEN {_HEX.format(43)} % 1000 < 800 THEN {_prompts('en', 0)} ELSE {_prompts('zh', 0)} END AS query, '<bbox>' AS response FROM documents")
def nrm09_grounding_prompt(table):
    d = table("documents").select("doc_id", X.grounding_prompt("grounding", F.col("doc_id")).alias("p"))
    return d.select("doc_id", "p.query", "p.response")


@query(f"SELECT doc_id, {said(('user', 'lang'), ('assistant', 'source'))} AS messages FROM documents")
def txt12_repaired_literals(table):
    """Lists of dicts with each of the breaks that stand for a comma."""
    gap = F.element_at(F.array(F.lit("\n"), F.lit("\n "), F.lit(""), F.lit("\n  ")), (F.col("doc_id") % 4 + 1).cast("int"))
    text = F.concat(F.lit("[{'role': 'user', 'content': '"), "lang", F.lit("'}"), gap, F.lit("{'role': 'assistant', 'content': '"), "source", F.lit("'}]"))
    return X.repaired_literals(table("documents").select("doc_id", text.alias("conversations"))).select("doc_id", told("messages").alias("messages"))


@query(f"SELECT doc_id, {said(('system', Q * 2), ('user', 'lang'), ('assistant', 'text'))} AS messages FROM documents WHERE doc_id % 3 = 0")
def txt13_chat_room(table):
    """Rows whose first turn isn't the user's have no query and go."""
    turn = lambda a, b: F.struct(a.alias("from"), b.alias("value"))
    first = turn(F.when(F.col("doc_id") % 3 == 0, "user").otherwise("system"), F.col("lang"))
    d = table("documents").where("text <> ''").select("doc_id", F.array(first, turn(F.lit("ann"), F.col("source")), turn(F.lit("bob"), F.col("text"))).alias("conversations"))
    return X.chat_room(d).select("doc_id", told("messages").alias("messages"))


@query(f"SELECT doc_id, {said(('user', 'lang'), ('assistant', 'source'))} AS messages, text AS rejected_response FROM documents")
def txt19_chosen_turn(table):
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    d = table("documents").select("doc_id", F.array(turn("user", "lang")).alias("messages"), turn("assistant", "source").alias("chosen"), F.struct("text").alias("rejected"))
    return X.chosen_turn(d).select("doc_id", told("messages").alias("messages"), "rejected_response")


@query(f"SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN {said(('user', Q + 'a' + Q), ('assistant', Q + 'b' + Q), ('user', 'lang'), ('assistant', 'source'))} ELSE {said(('user', 'lang'), ('assistant', 'source'))} END AS messages FROM documents WHERE doc_id % 4 < 2")
def txt21_speaker_turns(table):
    """Turns that don't alternate, and empty ones, drop the row."""
    kinds = [F.lit("User:aAssistant:b"), F.lit(""), F.lit("Assistant:bUser:a"), F.lit("User:Assistant：b")]
    d = table("documents").select("doc_id", F.element_at(F.array(*kinds), (F.col("doc_id") % 4 + 1).cast("int")).alias("instruction"), F.concat(F.lit("User: "), "lang", F.lit(" ")).alias("input"), F.col("source").alias("output"))
    return X.speaker_turns(d).select("doc_id", told("messages").alias("messages"))


@listed("tools", f"SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN ['a', 'b'] END AS tools, md5(coalesce({_SPOKEN} FILTER (i > 0 OR role <> 'system'), '')) AS messages FROM {_TURNS} GROUP BY conv_id")
def txt22_described_functions(table):
    d = messages_of(table).withColumn("function_description", F.when(F.col("conv_id") % 2 == 0, "a\n\nb"))
    return X.described_functions(d).select("conv_id", "tools", told("messages").alias("messages"))


@query(f"SELECT url AS path, {said(('user', Q + '<image>' + Q))} AS anchor, {said(('user', 'page_id::VARCHAR'))} AS positive FROM pages")
def mm08_caption_pair(table):
    d = X.caption_pair(table("pages").select(F.col("url").alias("images"), F.array(F.col("page_id").cast("string"), F.lit("other")).alias("response")))
    return d.select(F.col("images")[0]["path"].alias("path"), told("messages").alias("anchor"), told(F.col("positive_messages")[0]).alias("positive"))


@query(f"SELECT doc_id, source AS solution, {said(('user', f'lang || {Q} Output the thinking process in <think> </think> and final answer (number) in <answer> </answer> tags.{Q}'), ('assistant', 'source'))} AS messages FROM documents")
def mm14_counted_objects(table):
    d = X.counted_objects(table("documents").select("doc_id", F.col("lang").alias("query"), F.col("source").alias("response")))
    return d.select("doc_id", "solution", told("messages").alias("messages"))


@query("SELECT name, ('0x' || substr(md5(name || '-42'), 1, 8))::BIGINT & 2147483647 AS seed FROM (SELECT DISTINCT event_type AS name FROM events)")
def set08_step_seeds(table):
    names = [row.name for row in table("events").select(F.col("event_type").alias("name")).distinct().collect()]
    return table("events").sparkSession.createDataFrame(list(O.step_seeds(42, names).items()), "name string, seed bigint")


@query("SELECT a.doc_id, b.doc_id AS other FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) a JOIN (SELECT doc_id, row_number() OVER (ORDER BY n_chars * 1000000 + doc_id) AS p FROM documents) b USING (p)")
def jon02_positional_join(table):
    docs = table("documents")
    other = docs.select(F.col("doc_id").alias("other"), (F.col("n_chars") * 1000000 + F.col("doc_id")).alias("o"))
    return S.positional_join(docs.select("doc_id"), other, "doc_id", "o").select("doc_id", "other")


@query("SELECT doc_id, greatest(n_chars % 5, doc_id % 7)::INTEGER AS length FROM documents")
def rnd20_encoded_length(table):
    def some(n):
        return F.when(n > 0, F.sequence(F.lit(1).cast("bigint"), F.greatest(n, F.lit(1))))

    return table("documents").select("doc_id", R.encoded_length(some(F.col("n_chars") % 5), some(F.col("doc_id") % 7)).alias("length"))


@query("SELECT doc_id, lang AS chosen, CASE WHEN doc_id % 2 = 0 THEN source END AS rejected, (doc_id % 3)::DOUBLE AS margin, doc_id % 5 > 0 AS label FROM documents")
def rnd21_preference_rows(table):
    made = S.preference_rows(F.col("lang"), F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("doc_id") % 3, (F.col("doc_id") % 5).cast("int"))
    return table("documents").select("doc_id", *[c.alias(n) for n, c in made.items()])


@query("""SELECT batch, (row_number() OVER (PARTITION BY batch ORDER BY s, doc_id) - 1)::INTEGER AS place, CASE s WHEN 0 THEN 'chosen' ELSE 'rejected' END AS side, v AS value FROM (
SELECT doc_id // 8 AS batch, doc_id, 0 AS s, lang AS v FROM documents UNION ALL SELECT doc_id // 8, doc_id, 1, source FROM documents WHERE doc_id % 3 > 0)""")
def pck06_preference_collate(table):
    docs = table("documents").select(F.floor(F.col("doc_id") / 8).alias("batch"), "doc_id", F.col("lang").alias("chosen"), F.when(F.col("doc_id") % 3 > 0, F.col("source")).alias("rejected"))
    return S.preference_collate(docs, "batch", "doc_id").select("batch", "place", "side", "value")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang END AS value FROM documents")
def str02_first_scalar(table):
    kind = "array<array<struct<lang:string,source:string>>>"
    empty = F.when(F.col("doc_id") % 2 == 0, F.array(F.array(F.struct("lang", "source")))).otherwise(F.array().cast(kind))
    d = table("documents").select("doc_id", empty.alias("x"))
    return d.select("doc_id", T.first_scalar(F.col("x"), d.schema["x"].dataType).alias("value"))


@query("SELECT p_partkey, least(p_size, 20)::INTEGER AS place FROM part")
def str04_lower_bound(table):
    values = F.sequence(F.lit(0), F.lit(19))
    return table("part").select("p_partkey", T.lower_bound(values, lambda x: x >= F.col("p_size"), 64).alias("place"))


@listed("weights", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [3.0] ELSE [1.0, 1.0, 3.0] END::DOUBLE[] AS weights FROM documents")
def lsc04_query_weights(table):
    """A query can set the weight of its whole response."""
    asked = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("What is the value of "), "lang")).otherwise(F.col("lang"))
    made = R.response_weights(F.lit("so Tool:x"), R.WEIGHT_MAPS["agentflan"], asked, R.QUERY_WEIGHTS["agentflan"])
    return table("documents").select("doc_id", F.transform(made, lambda p: p["weight"]).alias("weights"))
