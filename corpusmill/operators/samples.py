"""Instruction samples: prompt formats, label ranges and the train and validation split."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import as_col, strip

# Prompt templates.
SYSTEM_MESSAGE = "당신은 행정 문서 및 RAG 지식 기반 전문 AI 어시스턴트입니다."
ALPACA_WITH_INPUT = (
    "아래는 작업을 설명하는 지침과 추가 컨텍스트를 제공하는 입력의 조합입니다. 요청을 적절히 완료하는 응답을 작성하십시오.\n\n"
)
ALPACA_PLAIN = "아래는 작업을 설명하는 지침입니다. 요청을 적절히 완료하는 응답을 작성하십시오.\n\n"
INSTRUCTION_HEAD, INPUT_HEAD, ANSWER_HEAD = "### 지침:\n", "### 입력:\n", "### 응답:\n"
REFERENCE_HEAD = "[참고 자료]\n"
CURATED_INSTRUCTION = "다음 질의에 대해 신뢰할 수 있는 정확한 답변을 작성하십시오."
ASSISTANT_ROLES = ["gpt", "assistant", "bot"]
TURN_OPEN, TURN_CLOSE = "<|im_start|>", "<|im_end|>"


def _text(name: Column | str) -> Column:
    return strip(F.coalesce(as_col(name), F.lit("")))


def alpaca_prompt(instruction: Column | str, given: Column | str, output: Column | str) -> Column:
    task = F.concat(F.lit(INSTRUCTION_HEAD), _text(instruction), F.lit("\n\n"))
    answer = F.concat(F.lit(ANSWER_HEAD), _text(output))
    return F.when(_text(given) == "", F.concat(F.lit(ALPACA_PLAIN), task, answer)).otherwise(
        F.concat(F.lit(ALPACA_WITH_INPUT), task, F.lit(INPUT_HEAD), _text(given), F.lit("\n\n"), answer)
    )


def chat_turn(role: Column | str, content: Column | str) -> Column:
    """One turn; every role but the assistant's is written as the user."""
    tag = F.when(as_col(role).isin(ASSISTANT_ROLES), "assistant").otherwise("user")
    return F.concat(F.lit(TURN_OPEN), tag, F.lit("\n"), F.coalesce(as_col(content), F.lit("")), F.lit(TURN_CLOSE))


def system_turn(message: str = SYSTEM_MESSAGE) -> str:
    return f"{TURN_OPEN}system\n{message}{TURN_CLOSE}"


def chat_prompt(turns: Column | str, system: str = SYSTEM_MESSAGE) -> Column:
    """Prompt of a sample that holds its turns as ARRAY<STRUCT<from, value>>."""
    rendered = F.transform(as_col(turns), lambda t: chat_turn(F.coalesce(t["from"], F.lit("user")), t["value"]))
    return F.array_join(F.concat(F.array(F.lit(system_turn(system))), rendered), "\n")


def instruction_chat_prompt(instruction: Column | str, given: Column | str, output: Column | str,
                            system: str = SYSTEM_MESSAGE) -> Column:
    user = F.when(_text(given) == "", _text(instruction)).otherwise(
        F.concat(_text(instruction), F.lit("\n\n" + REFERENCE_HEAD), _text(given))
    )
    return F.concat(
        F.lit(system_turn(system) + "\n" + TURN_OPEN + "user\n"), user,
        F.lit(TURN_CLOSE + "\n" + TURN_OPEN + "assistant\n"), _text(output), F.lit(TURN_CLOSE),
    )


def conversation_turns(df: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    """(conversation, seq, segment): a conversation's prompt, one row per turn in seq order.

    Turns stay rows: joining a long conversation into one value would put it into one task.
    The segments of a conversation joined by line feeds are its prompt.
    """
    heads = df.select(conversation).distinct().select(
        conversation, F.lit(-1).cast("bigint").alias("seq"), F.lit(system_turn()).alias("segment")
    )
    return heads.unionByName(
        df.select(conversation, F.col(turn).cast("bigint").alias("seq"), chat_turn(role, text).alias("segment"))
    )


RANGES = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(RANGES)
def label_ranges(prompts: pd.Series) -> pd.Series:
    """Character ranges that are trained on: assistant turns, else what follows the answer head."""
    import re

    turn = re.compile(r"<\|im_start\|>assistant\n(.*?)(<\|im_end\|>|$)", re.DOTALL)

    def ranges(prompt: str) -> list[dict]:
        found = [{"start": m.start(1), "end": m.end(2)} for m in turn.finditer(prompt)]
        at = prompt.find(ANSWER_HEAD)
        if not found and at >= 0:
            found = [{"start": at + len(ANSWER_HEAD), "end": len(prompt)}]
        return found

    return prompts.map(ranges, na_action="ignore")


def train_validation(df: DataFrame, key: str, ratio: float = 0.9, seed: int = 42) -> DataFrame:
    """Adds ``split``; the same key always falls on the same side, on any cluster."""
    bucket = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000))
    return df.withColumn("split", F.when(bucket < int(ratio * 10_000), "train").otherwise("validation"))
