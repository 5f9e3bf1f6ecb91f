"""Answer token streams released only after their text has been checked.

Per trace, tokens are buffered up to a sentence or line end (or a long window), never inside a
personal-data match, checked together with what follows, masked or stopped, and sent on in
small pieces. After the last token the whole answer is checked once more.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.pii import find_spans, mask_spans
from ..operators.guardrails import LEAK_PATTERNS

# Window, tail, look-ahead and piece sizes, sentence ends, and the refusal.
WINDOW, TAIL, LOOKAHEAD, PIECE = 480, 64, 64, 48
BOUNDARY = re.compile(r"(?<=[.!?。！？])(?:[ \t]+|\n+)|\n+")
REFUSAL = "추가 응답은 출력 가드레일에 의해 보류되었습니다."
_LEAKS = [re.compile(p) for p in LEAK_PATTERNS]
_WORD = re.compile(r"[가-힣a-zA-Z0-9]{3,}")

TOKEN_SCHEMA = "trace_id string, seq bigint, token string, last boolean, context string"
EVENT_SCHEMA = "trace_id string, event bigint, type string, payload string"
STATE_SCHEMA = "state string"


def hallucination(answer: str, context: str) -> float:
    sentences = [s for s in map(str.strip, re.split(r"[.?!]\s+", answer)) if len(s) > 10]
    if not sentences or not context:
        return 0.0
    words = [_WORD.findall(s) for s in sentences]
    poor = sum(1 for w in words if w and sum(t in context for t in w) / len(w) < 0.25)
    return round(poor / len(sentences), 2)


def check(text: str, context: str) -> tuple[str, bool, str, list[tuple[str, str]], float]:
    """(action, severe, masked text, violations as (category, severity), hallucination score)."""
    spans = find_spans(text)
    found = [("privacy", "high")] if spans else []
    found += [("system_leak", "high") for p in _LEAKS if p.search(text)]
    score = hallucination(text, context)
    if score > 0.3:
        found.append(("faithfulness", "high" if score > 0.6 else "medium"))
    severe = any(c in ("faithfulness", "system_leak", "safety") and s == "high" for c, s in found)
    return "mask" if spans else "flag" if found else "allow", severe, mask_spans(text, spans), found, score


@dataclass
class Trace:
    """What is carried between batches for one answer."""

    expected: int = 0
    events: int = 0
    waiting: dict = field(default_factory=dict)
    pending: str = ""
    raw: str = ""
    context: str = ""
    action: str = "allow"
    violations: list = field(default_factory=list)
    blocked: bool = False


def _cut(pending: str) -> int | None:
    """Where the next segment may end, or None while more text is needed."""
    found = BOUNDARY.search(pending)
    if found:
        end = found.end()
    elif len(pending) > WINDOW:
        limit = len(pending) - TAIL
        end = max(pending.rfind(" ", 0, limit), pending.rfind("\n", 0, limit)) + 1
        end = end if end > 1 else limit
    else:
        return None
    for start, stop, *_rest in find_spans(pending):
        if start < end < stop:
            end = start
    return end if end > 0 else None


class Guard:
    def __init__(self, trace_id: str, trace: Trace):
        self.trace_id, self.trace, self.out = trace_id, trace, []

    def emit(self, kind: str, payload: dict) -> None:
        self.out.append((self.trace_id, self.trace.events, kind, json.dumps(payload, ensure_ascii=False)))
        self.trace.events += 1

    def send(self, text: str) -> None:
        for at in range(0, len(text), PIECE):
            self.emit("token", {"content": text[at : at + PIECE]})

    def note(self, violations: list) -> None:
        for item in violations:
            if list(item) not in self.trace.violations:
                self.trace.violations.append(list(item))

    def release(self, segment: str, following: str = "") -> None:
        trace = self.trace
        if not segment:
            return
        for text in ([segment + following] if following else []) + [segment]:
            action, severe, masked, found, _score = check(text, trace.context)
            if severe:
                self.note(found)
                trace.blocked, trace.action = True, "block"
                return
        self.note(found)
        if action == "mask":
            trace.action = "mask"
            self.emit("guardrail", {"phase": "stream", "action": "mask"})
        elif action == "flag" and trace.action == "allow":
            trace.action = "flag"
        self.send(masked if action == "mask" else segment)

    def take(self, token: str) -> None:
        trace = self.trace
        trace.raw += token
        if trace.blocked:
            return
        trace.pending += token
        while not trace.blocked and (end := _cut(trace.pending)) is not None:
            segment, trace.pending = trace.pending[:end], trace.pending[end:]
            self.release(segment, trace.pending[:LOOKAHEAD])

    def finish(self) -> None:
        trace = self.trace
        if not trace.blocked:
            self.release(trace.pending)
        action, severe, _masked, found, score = check(trace.raw, trace.context)
        self.note(found)
        if severe:
            trace.blocked, trace.action = True, "block"
        elif action == "mask" or (action == "flag" and trace.action == "allow"):
            trace.action = action
        if trace.blocked:
            self.send(REFUSAL)
        self.emit("guardrail", {
            "phase": "final", "action": trace.action, "faithfulness": round(1.0 - score, 4),
            "violations": [{"category": c, "severity": s} for c, s in trace.violations],
        })
        self.emit("done", {})


def _advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    trace = Trace(**json.loads(state.get[0])) if state.exists else Trace()
    guard = Guard(key[0], trace)
    for frame in frames:
        for seq, token, last, context in zip(frame["seq"], frame["token"], frame["last"], frame["context"]):
            trace.waiting[str(seq)] = [token or "", bool(last)]
            trace.context = trace.context or (context or "")
    done = False
    while not done and (item := trace.waiting.pop(str(trace.expected), None)) is not None:
        trace.expected += 1
        guard.take(item[0])
        done = item[1]
    if done:
        guard.finish()
        state.remove()
    else:
        state.update((json.dumps(asdict(trace), ensure_ascii=False),))
    yield pd.DataFrame(guard.out, columns=["trace_id", "event", "type", "payload"])


def guard_tokens(tokens: DataFrame) -> DataFrame:
    """Events (trace_id, event, type, payload) of a token stream with ``TOKEN_SCHEMA``.

    Tokens may arrive out of order; one that is ahead waits in the state of its trace.
    """
    return tokens.groupBy("trace_id").applyInPandasWithState(
        _advance, EVENT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )
