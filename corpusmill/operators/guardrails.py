"""Input and output guardrails as columns: violations, risk and action."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.pii import masked_text, pii_spans, scan_pii
from ..functions.text import as_col, citations, let, plain_token_set, rounded, sentences_after_stop, strip

# Input rules as (rule, category, severity, pattern).
INPUT_RULES = [
    ("instruction_override", "prompt_injection", "critical",
     r"(?i)(ignore\s+(all\s+)?(previous|prior|above)\s+instructions|"
     r"disregard\s+(all\s+)?(previous|prior|above)\s+instructions|"
     r"이전\s*(지시|명령|프롬프트|규칙)(들을|들을 전부|를)?\s*(무시|폐기|잊어|취소)|"
     r"기존\s*(설정|규칙|지침)(들을|을)?\s*(무시|따르지 마))"),
    ("system_prompt_leakage", "system_leak", "critical",
     r"(?i)(repeat\s+(the\s+)?(words\s+above|system\s+prompt)|print\s+(the\s+)?system\s+prompt|"
     r"what\s+is\s+your\s+system\s+prompt|reveal\s+your\s+(instructions|system\s+prompt)|"
     r"시스템\s*(프롬프트|지시사항|명령어)를?\s*(출력|공개|알려줘|말해줘))"),
    ("role_hijacking_jailbreak", "jailbreak", "high",
     r"(?i)(you\s+are\s+now\s+in\s+DAN\s+mode|do\s+anything\s+now|unfiltered\s+mode|developer\s+mode\s+enabled|"
     r"너는\s*지금부터\s*(무제한|자유로운|모든\s*규칙을\s*무시하는)\s*AI다|개발자\s*모드로\s*전환)"),
    ("delimiter_injection", "delimiter_attack", "high",
     r"(```\s*(system|assistant|instruction|human|user)[\r\n]|<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]|"
     r"<\|system\|>|<\|user\|>|<\|assistant\|>)"),
    ("hidden_instruction_comment", "obfuscation", "medium",
     r"(<!--\s*(system|instruction|override|execute)[\s\S]*?-->|/\*\s*(system|instruction|override)[\s\S]*?\*/)"),
    ("hypothetical_jailbreak", "jailbreak", "medium",
     r"(?i)(in\s+a\s+purely\s+hypothetical\s+fictional\s+scenario\s+where\s+safety\s+does\s+not\s+matter|"
     r"가상의\s*소설 속\s*상황이라고\s*가정하고\s*(법적|윤리적|보안)\s*제한\s*없이)"),
    ("malware_creation", "safety", "critical",
     r"(?i)(악성코드\s*(제작|작성|배포)|랜섬웨어\s*(코드|만드는 법)|ddos\s*공격\s*(스크립트|도구)|"
     r"write\s+(a\s+)?(keylogger|ransomware|trojan|rootkit))"),
    ("sql_injection_attempt", "safety", "high",
     r"(?i)(union\s+select\s+.*\s+from|drop\s+table\s+rag_|;\s*drop\s+database|'\s*or\s+'1'='1)"),
]
INVISIBLE = r"[\x00\x{200B}-\x{200D}\x{FEFF}]"
LEAK_PATTERNS = [
    r"(?i)you\s+are\s+a\s+helpful\s+assistant", r"(?i)my\s+instructions\s+are\s+to",
    r"제\s*시스템\s*프롬프트는\s*다음과\s*같습니다",
]
SEVERITY_RISK = {"critical": 0.5, "high": 0.3, "medium": 0.15, "low": 0.05}
BLOCKING = ["prompt_injection", "system_leak", "safety", "jailbreak", "input_size"]
MILD_PII = ["이메일주소", "일반전화번호"]
WITHHOLDING = ["faithfulness", "system_leak", "safety"]
MATCH_LENGTH = 60


def _violation(rule, category, severity, matched=None, start=None, end=None) -> Column:
    lit = lambda v, t: v.cast(t) if isinstance(v, Column) else F.lit(v).cast(t)
    return F.struct(
        lit(rule, "string").alias("rule_name"), lit(category, "string").alias("category"),
        lit(severity, "string").alias("severity"), lit(matched, "string").alias("matched_pattern"),
        lit(start, "int").alias("offset_start"), lit(end, "int").alias("offset_end"),
    )


def _rule_violation(text: Column, rule: str, category: str, severity: str, pattern: str) -> Column:
    def build(match: Column) -> Column:
        # No rule looks around its match, so the first place its text occurs is the match.
        start = F.instr(text, match) - 1
        return F.when(match != "", _violation(
            rule, category, severity, F.substring(match, 1, MATCH_LENGTH), start, start + F.length(match)
        ))

    return let(F.regexp_extract(text, "(?U)" + pattern, 0), build)


def input_guardrail(df: DataFrame, text: str = "text", max_length: int = 16384, mask: bool = True,
                    block: bool = True) -> DataFrame:
    """Adds passed, action, risk_score, violations, sanitized_text, pii_count, violation_count."""
    raw = F.coalesce(F.col(text), F.lit(""))
    work = df.withColumn("__text", raw).withColumn("__scan", scan_pii("__text"))
    body = F.col("__text")
    fixed = [
        F.when(F.length(body) > max_length, _violation("max_length_exceeded", "input_size", "high")),
        F.when(body.rlike(INVISIBLE), _violation("invisible_characters", "obfuscation", "medium")),
        *[_rule_violation(body, *rule) for rule in INPUT_RULES],
    ]
    personal = F.transform(pii_spans(F.col("__scan")), lambda s: _violation(
        "pii_detected", "privacy", F.when(s["category"].isin(MILD_PII), "medium").otherwise("high"),
        F.concat(F.lit("type:"), s["category"]), s["start"], s["end"],
    ))
    work = (
        work.withColumn("__spans", pii_spans(F.col("__scan")))
        .withColumn("violations", F.concat(F.array_compact(F.array(*fixed)), personal))
    )
    has = lambda test: F.exists("violations", test)
    serious = has(lambda v: (v["severity"] == "critical")
                  | ((v["severity"] == "high") & v["category"].isin(BLOCKING)))
    weight = F.create_map(*[F.lit(x) for pair in SEVERITY_RISK.items() for x in pair])
    risk = F.aggregate("violations", F.lit(0.0), lambda acc, v: acc + F.element_at(weight, v["severity"]))
    return (
        work.withColumn("__block", F.lit(block) & serious)
        .select(
            *df.columns, (~F.col("__block")).alias("passed"),
            F.when(F.col("__block"), "block").when(F.lit(mask) & (F.size("__spans") > 0), "mask")
            .when(F.size("violations") > 0, "flag").otherwise("allow").alias("action"),
            F.least(F.lit(1.0), rounded(risk, 2)).alias("risk_score"),
            "violations",
            (masked_text(F.col("__scan"), "__text") if mask else F.col("__text")).alias("sanitized_text"),
            F.size("__spans").alias("pii_count"), F.size("violations").alias("violation_count"),
            F.length("__text").alias("original_length"),
        )
    )


def hallucination_score(answer: Column | str, context: Column | str) -> Column:
    """Share of sentences with fewer than a quarter of their longer words in the context."""
    answer, context = as_col(answer), as_col(context)

    def score(sentences: Column) -> Column:
        def unsupported(sentence: Column) -> Column:
            def judge(words: Column) -> Column:
                known = F.size(F.filter(words, lambda w: F.contains(context, w)))
                return (F.size(words) > 0) & (known / F.size(words) < 0.25)

            return let(F.regexp_extract_all(sentence, F.lit("[가-힣a-zA-Z0-9]{3,}"), F.lit(0)), judge)

        bad = F.size(F.filter(sentences, unsupported))
        return F.when(F.size(sentences) > 0, bad / F.size(sentences)).otherwise(0.0)

    return F.when(F.coalesce(context, F.lit("")) == "", 0.0).otherwise(
        rounded(let(sentences_after_stop(answer), score), 2)
    )


def output_guardrail(df: DataFrame, answer: str = "answer", context: str = "context", mask: bool = True) -> DataFrame:
    """Adds action, risk_score, violations, hallucination_score, sanitized_text and withheld.

    ``context`` is the joined text of the retrieved chunks. ``withheld`` marks answers that
    must be replaced.
    """
    empty = F.coalesce(F.col(answer), F.lit("")) == ""
    work = df.withColumn("__scan", scan_pii(answer)).withColumn(
        "hallucination_score", F.when(empty, 0.0).otherwise(hallucination_score(answer, context))
    )
    score = F.col("hallucination_score")
    body = F.col(answer)
    checks = [
        F.when(F.size(pii_spans(F.col("__scan"))) > 0, _violation("output_pii_leakage", "privacy", "high")),
        *[F.when(body.rlike("(?U)" + p), _violation("system_prompt_leakage_detected", "system_leak", "high")) for p in LEAK_PATTERNS],
        F.when(score > 0.6, _violation("high_hallucination_risk", "faithfulness", "high"))
        .when(score > 0.3, _violation("moderate_hallucination_risk", "faithfulness", "medium")),
    ]
    work = work.withColumn("violations", F.array_compact(F.array(*checks))).withColumn(
        "pii_count", F.size(pii_spans(F.col("__scan")))
    )
    risk = F.least(F.lit(1.0), rounded(F.size("violations") * 0.25 + score * 0.5, 2))
    action = (
        F.when(F.lit(mask) & (F.col("pii_count") > 0), "mask").when(F.size("violations") > 0, "flag").otherwise("allow")
    )
    severe = F.exists("violations", lambda v: v["severity"].isin("critical", "high") & v["category"].isin(WITHHOLDING))
    return work.select(
        *df.columns, F.lit(True).alias("passed"), action.alias("action"), risk.alias("risk_score"), "violations",
        "hallucination_score", "pii_count", severe.alias("withheld"),
        F.coalesce(masked_text(F.col("__scan"), answer) if mask else body, F.lit("")).alias("sanitized_text"),
    )


def attribution(df: DataFrame, answer: str = "answer", scores: str = "scores", texts: str = "texts") -> DataFrame:
    """Adds confidence_score, hallucination_risk, grounding_ratio and the citation lists.

    ``scores`` and ``texts`` are arrays over the few hits of the answer.
    """
    hits = F.when(F.col(scores).isNull(), 0).otherwise(F.size(scores))
    mean = F.aggregate(scores, F.lit(0.0), lambda a, s: a + F.coalesce(F.nullif(s, F.lit(0.0)), F.lit(0.5))) / hits
    blank = strip(F.coalesce(F.col(answer), F.lit(""))) == ""
    work = (
        df.withColumn("__hits", hits)
        .withColumn("__base", F.least(F.lit(1.0), F.greatest(F.lit(0.0), mean)))
        .withColumn("__cited", citations(answer))
        .withColumn("__answer", plain_token_set(answer))
        .withColumn("__context", plain_token_set(F.array_join(texts, " ")))
    )
    valid = F.filter("__cited", lambda c: (c >= 1) & (c <= F.col("__hits")))
    shared = F.size(F.array_intersect("__answer", "__context")) / F.greatest(F.size("__answer"), F.lit(1))
    work = (
        work.withColumn("__valid", valid)
        .withColumn("__invalid", F.array_except("__cited", "__valid"))
        .withColumn("__ground", shared)
    )
    cited, wrong = F.size("__valid") > 0, F.size("__invalid") > 0
    raw = F.col("__base") * 0.4 + F.col("__ground") * 0.4 + F.when(cited, 0.2).otherwise(0.0)
    raw = F.when(wrong, F.greatest(F.lit(0.0), raw - 0.25)).otherwise(raw)
    final = rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw)), 2)
    risk = (
        F.when(wrong | (~cited & (F.col("__ground") < 0.20)) | (F.col("__final") < 0.35), "high")
        .when(~cited | (F.col("__final") < 0.60) | (F.col("__ground") < 0.30), "medium")
        .otherwise("low")
    )
    none = F.array().cast("array<bigint>")
    return work.withColumn("__final", final).select(
        *df.columns,
        F.when(F.col("__hits") == 0, 0.0).when(blank, rounded(F.col("__base"), 2)).otherwise(F.col("__final")).alias("confidence_score"),
        F.when(F.col("__hits") == 0, "high")
        .when(blank, F.when(F.col("__base") >= 0.5, "low").otherwise("medium"))
        .otherwise(risk).alias("hallucination_risk"),
        F.when(blank | (F.col("__hits") == 0), 0.0).otherwise(rounded(F.col("__ground"), 2)).alias("grounding_ratio"),
        F.when(blank | (F.col("__hits") == 0), none).otherwise(F.array_sort(F.array_distinct("__valid"))).alias("valid_citations"),
        F.when(blank | (F.col("__hits") == 0), none).otherwise(F.array_sort(F.array_distinct("__invalid"))).alias("invalid_citations"),
    )
