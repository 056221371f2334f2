"""Rule-based text rewards, as columns."""

from __future__ import annotations

import json
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parley.functions.text import ngrams, strip, words


def think_answer_format(text: Column) -> Column:
    """1 where the whole text is a think block and an answer block."""
    return F.coalesce(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?</answer>\z"), F.lit(False)).cast("double")


def react_format(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)\A<think>.*?</think>\s*Action:.*?Action Input:.*?\z"), F.lit(False)).cast("double")


def repetition(text: Column, n: int = 3, penalty: float = -1.0) -> Column:
    """(1 - distinct / all n-grams) * penalty of lower-cased words; 0 for fewer than n words."""
    grams = ngrams(words(F.lower(F.coalesce(text, F.lit("")))), n)
    return F.transform(F.array(grams), lambda g: F.when(F.size(g) > 0, (1 - F.size(F.array_distinct(g)) / F.size(g)) * penalty).otherwise(0.0))[0]


def cosine_length(length: Column, correct: Column, most: int, min_wrong: float = -0.5, max_wrong: float = 0.0, min_right: float = 0.5, max_right: float = 1.0) -> Column:
    """Cosine over the length from max to min for right answers, and from min to max for wrong ones."""
    low = F.when(correct, F.lit(min_right)).otherwise(F.lit(max_wrong))
    high = F.when(correct, F.lit(max_right)).otherwise(F.lit(min_wrong))
    return high - (high - low) * (1 - F.cos(length * math.pi / most)) / 2


def soft_overlong(length: Column, most: int, cache: int) -> Column:
    """0 up to most - cache, then falling linearly."""
    if cache >= most:
        raise ValueError("the cache must be shorter than the limit")
    return F.least(-(length - (most - cache)) / cache, F.lit(0.0))


def boxed(text: Column) -> Column:
    """What the first \\boxed{...} holds, with braces in it two deep at most."""
    return F.regexp_extract(text, r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}", 1)


def answer_text(text: Column) -> Column:
    """What an answer block holds, or the whole text."""
    found = F.regexp_extract(text, r"(?s)<answer>(.*?)</answer>", 1)
    return strip(F.when(found != "", found).otherwise(text))


def plain_math(text: str | None) -> Fraction | str | None:
    """A number of a short expression, or its text without mark-up: a stand-in for symbolic equality."""
    if text is None:
        return None
    t = re.sub(r"\\(left|right|,|;|!|text|mathrm)|[$\s{}]|\\%|%", "", re.sub(r"\\d?frac\{([^{}]*)\}\{([^{}]*)\}", r"(\1)/(\2)", text)).replace("\\cdot", "*").replace("\\times", "*").rstrip(".")
    t = re.sub(r"(?<=\d),(?=\d{3}\b)", "", t)
    m = re.fullmatch(r"\(?(-?\d+(?:\.\d+)?)\)?(?:/\(?(-?\d+(?:\.\d+)?)\)?)?", t)
    if m:
        bottom = Fraction(m[2] or 1)
        return Fraction(m[1]) / bottom if bottom else t
    return t.lower()


def _pairs(function: Callable[[str | None, str | None], float | None]):
    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([function(x, y) for x, y in zip(a, b)], dtype="float64")

    return run


def math_accuracy(completion: Column, solution: Column) -> Column:
    """1 where the answers, boxed or in answer blocks, are the same number or text. Equal forms that need algebra aren't
    seen as equal; that is weaker than symbolic verification."""

    def final(c: Column) -> Column:
        b = boxed(c)
        return F.when(b != "", b).otherwise(answer_text(c))

    return _pairs(lambda x, y: float(x is not None and y is not None and plain_math(x) == plain_math(y)))(final(completion), final(solution))


def parse_action(text: str | None) -> tuple[str, str]:
    """The last Action and Action Input."""
    found = re.findall(r"Action:(.*?)Action Input:(.*?)(?=Observation:|Action:|\Z)", text or "", re.S)
    return (found[-1][0].strip(), found[-1][1].strip()) if found else ("", "")


def action_score(completion: str | None, solution: str | None) -> float:
    """1 where the action is the solution's and all of its arguments agree."""
    (name, given), (want, wanted) = parse_action(completion), parse_action(solution)
    if name != want or not name:
        return 0.0
    try:
        a, b = json.loads(given), json.loads(wanted)
    except ValueError:
        return 0.0  # texts would be compared by thresholds that an F value can't reach
    if not isinstance(a, dict) or not isinstance(b, dict):
        return float(a == b)
    if not a and not b:
        return 1.0
    hits = sum(1.0 if a[k] == b[k] else 0.5 for k in a.keys() & b.keys())
    f1 = 2 * hits / (len(a) + len(b))
    return float(f1 == 1)


def tool_action(completion: Column, solution: Column) -> Column:
    return _pairs(action_score)(completion, solution)


def judged(text: Column) -> Column:
    """The number behind Reward:, else 0."""
    return F.coalesce(F.expr("1.0D") * F.regexp_extract(text, r"Reward:\s*([0-1](?:\.\d+)?)", 1).try_cast("double"), F.lit(0.0))


def mean_judgement(choices: Column) -> Column:
    """Mean of the choices that have a number, else 0."""
    found = F.filter(F.transform(choices, lambda c: F.regexp_extract(c, r"Reward:\s*([0-1](?:\.\d+)?)", 1).try_cast("double")), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, F.aggregate(found, F.lit(0.0), lambda s, x: s + x) / F.size(found)).otherwise(0.0)


def role_lines(messages: Column) -> Column:
    return F.array_join(F.transform(messages, lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])), "\n")


def countdown_score(answer: str | None, target: float, numbers: list[int]) -> float:
    """1 where the equation uses each number once and gives the target."""
    m = re.search(r"<answer>(.*?)</answer>", answer or "", re.S)
    text = (m[1] if m else "").split("=")[0].strip()
    if not re.fullmatch(r"[\d+\-*/().\s]+", text) or "**" in text or "//" in text:
        return 0.0
    if sorted(map(int, re.findall(r"\d+", text))) != sorted(numbers):
        return 0.0
    try:
        return float(abs(eval(text, {"__builtins__": {}}) - target) < 1e-5)  # noqa: S307  (digits and operators only)
    except (SyntaxError, ZeroDivisionError, TypeError):
        return 0.0


def countdown(completion: Column, target: Column, numbers: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, t, n in parts:
            yield pd.Series([countdown_score(x, y, [] if z is None else [int(i) for i in z]) for x, y, z in zip(a, t, n)], dtype="float64")

    return run(completion, target, numbers)


def code_format(text: Column, language: Column) -> Column:
    return F.coalesce(text.rlike(r"(?s)\A<think>.*?</think>\s*<answer>.*?```.*?```.*?</answer>(?![\s\S])") & F.contains(text, F.concat(F.lit("```"), language)), F.lit(False)).cast("double")


def multiset_similarity(a: list[str], b: list[str]) -> float:
    both, every = Counter(a) & Counter(b), Counter(a) | Counter(b)
    return sum(both.values()) / sum(every.values()) if every else 1.0


def combine(df, rewards: dict[str, Column]):
    """One column per reward; null where it doesn't apply."""
    return df.withColumns(rewards)


REWARDS: dict[str, Callable[..., Column]] = {
    "format": think_answer_format, "react_format": react_format, "repetition": repetition, "cosine": cosine_length,
    "soft_overlong": soft_overlong, "accuracy": math_accuracy, "math": math_accuracy, "toolbench": tool_action,
}
