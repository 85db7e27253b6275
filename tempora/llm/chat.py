"""Chat transcripts to canonical turns by a hidden Markov model.

A transcript is plain text. Its lines are observed by speaker marker and form; the hidden state of a
line is its speaker's role and whether it opens a turn. Transition and emission counts come from
conversations with known roles, Viterbi decoding recovers the states, and turns are rendered in one
canonical form. A turn's text is all that stands between its marker and the next turn, blank lines
and lines that look like markers included.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import materialize

ROLES = ("system", "user", "assistant", "other")
#: A state is 2 * role + (1 if the line opens a turn).
STATES = 2 * len(ROLES)
#: Turn numbers that a transcript spans, and rows that it holds at most (twice as many by chance, where
#: turn numbers repeat); a longer conversation gives several transcripts.
SEGMENT, MOST_ROWS = 64, 256
# Speaker markers and the class that each stands for.
MARKERS = {
    "system": "system", "sys": "system", "instruction": "system", "instructions": "system", "context": "system",
    "user": "user", "human": "user", "q": "user", "question": "user", "customer": "user", "you": "user", "prompter": "user",
    "assistant": "assistant", "ai": "assistant", "a": "assistant", "answer": "assistant", "bot": "assistant", "agent": "assistant", "model": "assistant",
    "other": "other", "tool": "other", "function": "other", "observation": "other",
}
_MARKER = re.compile(r"^\s{0,3}(?:[#*>\[<|]{0,4}\s*)(" + "|".join(sorted(MARKERS, key=len, reverse=True)) + r")(?:\s*[\]>|*]{0,3})\s*[:：>\]]\**[ \t]*", re.I)
#: A marker word that isn't the one this transcript uses for its class.
ODD = len(ROLES) + 1
#: Features of a line and how many values each has.
FEATURES = (("marker", ODD + 1), ("first", 2), ("after_blank", 3), ("question", 2), ("length", 6))


#: Share of a feature's probability that all its values have alike, but for markers; and share of the lines
#: inside turns that follow a blank line, where these part no turns.
LEAST, BODY_BLANKS = 0.002, 0.05


@dataclass
class Line:
    at: int  # its place among all lines
    body: str  # without the marker
    features: tuple[int, ...]


def lines_of(transcript: str, starts: bool = True) -> list[Line]:
    """The non-blank lines with their features: marker class, first line of the chat, blank before,
    question, length. A transcript has one marker word for a class, the most frequent, of equally
    frequent ones the first; another word of this class counts as odd. Blank lines before a line are 1,
    or 2 in a transcript of which a marked line follows none: there they don't part turns."""
    raw = transcript.split("\n")
    found = [_MARKER.match(x) for x in raw]
    often = Counter(m[1].lower() for m in found if m)
    own = {MARKERS[w]: w for w, _ in reversed(often.most_common())}
    full = [at for at, text in enumerate(raw) if text.strip()]
    blank = 1 if all(not raw[at - 1].strip() for at in full[1:] if found[at] and own[MARKERS[found[at][1].lower()]] == found[at][1].lower()) else 2
    out: list[Line] = []
    for at in full:
        text, m = raw[at], found[at]
        word = m[1].lower() if m else ""
        marker = 0 if not m else 1 + ROLES.index(MARKERS[word]) if own[MARKERS[word]] == word else ODD
        body = text[m.end() :] if m else text
        length = min(5, int(np.log2(1 + len(body)) // 2))
        after = blank if out and not raw[at - 1].strip() else 0
        out.append(Line(at, body, (marker, int(starts and not out), after, int(body.rstrip().endswith("?")), length)))
    return out


@dataclass
class Model:
    """Logarithms of the start, transition and emission probabilities."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    def states(self, lines: list[Line], starts: bool = True) -> list[int]:
        """The likeliest states, by Viterbi; ties go to the lower state. A transcript that goes on from
        another starts in any state."""
        score, back = None, []
        for line in lines:
            e = sum(t[:, v] for t, v in zip(self.emit, line.features, strict=True))
            if score is None:
                score = (self.start if starts else np.zeros(STATES)) + e
                continue
            each = score[:, None] + self.move
            back.append(each.argmax(0))
            score = each.max(0) + e
        if score is None:
            return []
        path = [int(score.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        return path[::-1]

    def turns(self, transcript: str, starts: bool = True) -> list[tuple[str, str]]:
        """(role, text) of each turn, without white space at its ends. The marker isn't part of the text,
        if it is the one of this role."""
        lines, opened = lines_of(transcript, starts), []
        for line, state in zip(lines, self.states(lines, starts), strict=True):
            if state % 2 or not opened or opened[-1][0] != state // 2:
                opened.append((state // 2, line))
        raw, out = transcript.split("\n"), []
        if not opened:
            return out
        for (role, line), after in zip(opened, [x.at for _, x in opened[1:]] + [len(raw)], strict=True):
            first = line.body if line.features[0] == 1 + role else raw[line.at]
            out.append((ROLES[role], "\n".join([first, *raw[line.at + 1 : after]]).strip()))
        return out


def rendered(turns: list[tuple[str, str]]) -> str:
    """The canonical form. In texts each ``<|`` gets one more bar, so that no text can look like a mark."""
    return "".join(f"<|{role}|>\n{text.replace('<|', '<||')}\n<|end|>\n" for role, text in turns)


def unrendered(chat: str) -> list[tuple[str, str]]:
    """The turns that :func:`rendered` was given."""
    found = re.findall(r"<\|([a-z]+)\|>\n(.*?)\n<\|end\|>\n", chat, re.S)
    return [(role, text.replace("<||", "<|")) for role, text in found]


def transcripts(messages: DataFrame, marker: Column, between: Column) -> DataFrame:
    """conv_id, segment, part, parts (the marked turns), transcript, roles, n_blank of messages (conv_id,
    turn, role, text).

    ``marker`` is the text put before each turn and ``between`` what stands between turns, as raw chats
    have it. Turns of equal number are ordered by role and text, a null number counts 0. Null and blank
    texts are no turns and counted in n_blank; roles other than the first three are ``other``; rows without conv_id make transcripts of
    a null conv_id. ``SEGMENT`` turn numbers make a transcript at most; where numbers repeat, rows are
    dealt to parts by hash, so that no conversation has to fit one task.
    """
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("other")
    m = messages.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("at"), role.alias("role"), F.col("text"), marker.alias("marker"), between.alias("between"))
    m = m.withColumn("segment", F.expr(f"at div {SEGMENT}"))
    crowd = m.groupBy("conv_id", "segment").agg(F.count("*").alias("n")).where(F.col("n") > MOST_ROWS).select(F.col("conv_id").alias("c"), F.col("segment").alias("s"), "n")
    m = m.join(crowd, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("segment") == F.col("s")), "left")
    m = m.withColumn("part", F.coalesce(F.pmod(F.xxhash64("at", "role", "text"), F.ceil(F.col("n") / MOST_ROWS)), F.lit(0)))
    full = F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    line = F.concat("marker", F.regexp_replace("text", r"^\s+|\s+$", ""))
    turns = F.array_sort(F.collect_list(F.when(full, F.struct("at", "role", line.alias("line")))))
    g = m.groupBy("conv_id", "segment", "part").agg(turns.alias("t"), F.count_if(~full).alias("n_blank"), F.min("between").alias("between"))
    return g.select("conv_id", "segment", "part", F.col("t.line").alias("parts"), F.expr("array_join(t.line, between)").alias("transcript"), F.col("t.role").alias("roles"), "n_blank")


def _observed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts of (kind, state, value) over the transcripts of a batch."""
    for frame in frames:
        counts: Counter[tuple[int, int, int]] = Counter()
        for text, roles, parts, segment in frame.itertuples(index=False):
            sizes = [sum(bool(x.strip()) for x in part.split("\n")) for part in parts]
            states = [2 * ROLES.index(r) + (k == 0) for r, n in zip(roles, sizes, strict=True) for k in range(n)]
            lines = lines_of(text, segment == 0)
            for i, (line, s) in enumerate(zip(lines, states, strict=True)):
                if i or segment == 0:
                    counts[(-1, states[i - 1], s) if i else (-2, 0, s)] += 1
                counts.update((k, s, v) for k, v in enumerate(line.features))
        yield pd.DataFrame([(*k, n) for k, n in counts.items()], columns=["kind", "state", "value", "n"])


def train(labelled: DataFrame) -> Model:
    """Fit on all of ``labelled`` (transcript, roles, parts, segment). The counts start from a prior:
    turns go on more often than they change, a line that opens a turn has its role's marker, and others
    have none, or an odd one, or follow a blank line that parts no turns. A share of ``LEAST`` of each form is anyone's."""
    rows = labelled.select("transcript", "roles", "parts", "segment").mapInPandas(_observed, "kind int, state int, value int, n long")
    start, move = np.full(STATES, 0.5), np.full((STATES, STATES), 0.5)
    emit = [np.full((STATES, n), 0.05 if name == "marker" else 0.5) for name, n in FEATURES]
    move[:, ::2] = start[::2] = 1e-9  # a turn goes on only from its own role
    for role in range(len(ROLES)):
        move[2 * role : 2 * role + 2, 2 * role] = 4.5
        emit[0][2 * role + 1, 1 + role] += 20
        emit[0][2 * role, 0] += 20
        emit[0][2 * role, ODD] += 2
    for kind, state, value, n in rows.groupBy("kind", "state", "value").agg(F.sum("n")).collect():  # some hundred rows
        if kind == -2:
            start[value] += n
        elif kind == -1:
            move[state, value] += n
        else:
            emit[kind][state, value] += n
    emit[2][::2, 2] += BODY_BLANKS * emit[2][::2].sum(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    forms = [np.log((1 - LEAST) * norm(e) + LEAST / e.shape[1]) if k else np.log(norm(e)) for k, e in enumerate(emit)]
    return Model(np.log(norm(start)), np.log(norm(move)), forms)


def parsed(frame: DataFrame, model: Model) -> DataFrame:
    """``frame`` (with transcript; with segment, those after 0 go on from another) plus turns, an array of
    (role, text), and chat, their rendering. Columns of these names are replaced.

    Defined cases: a null or blank transcript has no turns and renders as an empty string; a first
    line that opens no turn opens one nevertheless; repeated rows parse alike; an empty table gives
    an empty result.
    """
    shared, kind = frame.sparkSession.sparkContext.broadcast(model), "struct<turns:array<struct<role:string,text:string>>,chat:string>"
    arrow = to_arrow_type(_parse_datatype_string(kind))

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, starts in batches:
            out = []
            for text, s in zip(texts, starts, strict=True):
                turns = shared.value.turns(text.as_py(), s.as_py()) if text.is_valid else []
                out.append({"turns": [{"role": r, "text": t} for r, t in turns], "chat": rendered(turns)})
            yield pa.array(out, arrow)

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    starts = F.coalesce(F.col("segment") == 0, F.lit(True)) if "segment" in frame.columns else F.lit(True)
    got = frame.withColumn("__parsed", F.arrow_udf(run, kind)("transcript", starts))
    return got.withColumns({"turns": F.col("__parsed.turns"), "chat": F.col("__parsed.chat")}).drop("__parsed")


#: Markers of the roles in three styles of raw chats.
STYLES = (("System: ", "User: ", "Assistant: ", "Other: "), ("### Instruction: ", "Human: ", "AI: ", "Tool: "), ("Context: ", "Q: ", "A: ", "Observation: "))


def style_of(conv_id: Column) -> Column:
    """0 to 2: the style; 3: that of 0 with markers left out."""
    return F.pmod(F.xxhash64(conv_id), F.lit(len(STYLES) + 1))


def marked_transcripts(messages: DataFrame) -> DataFrame:
    """Transcripts in the styles that raw chats have, one a conversation by its id: three sets of
    markers, and one that leaves out the marker of some turns. The latter two part turns by blank lines."""
    style = style_of(F.col("conv_id"))

    def of(names: tuple[str, ...]) -> Column:
        known = F.create_map(*(F.lit(x) for pair in zip(ROLES, names, strict=True) for x in pair))
        return F.coalesce(F.element_at(known, F.coalesce("role", F.lit("other"))), F.lit(names[-1]))

    bare = F.when(F.pmod(F.xxhash64("conv_id", "turn"), F.lit(3)) == 0, F.lit("")).otherwise(of(STYLES[0]))
    marker = F.when(style == 0, of(STYLES[0])).when(style == 1, of(STYLES[1])).when(style == 2, of(STYLES[2])).otherwise(bare)
    return materialize(transcripts(messages, marker, F.when(style < 2, "\n").otherwise("\n\n")), "transcripts")
