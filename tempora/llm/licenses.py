"""License scan by conditional compression.

Candidate blocks, the runs of lines with words that licenses use, are compressed alone and with each
template as zstandard raw dictionary. What a dictionary saves of a block is set against what it saves of
its own template, which is about 1 where the block holds the whole template and 0 where it holds nothing
of it, however long either is. Templates that reach this share far enough are ranked by the bytes they
save; the best are confirmed by the exact differences of wording. Long templates are compared with whole blocks, notices of a line, which a
long block would drown, with the words around each cue.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from difflib import SequenceMatcher

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_texts import TEMPLATES
from .udf import text_udf

#: Templates that are confirmed at most for a block; all are ranked.
BEST = 4
#: Least share of a template's words that a block must hold in order, and least reduction.
LEAST_WORDING, LEAST_REDUCTION = 0.8, 0.25
#: Words of a template that is a notice, at most, and words on either side of a cue that it is sought in.
NOTICE, NEAR = 12, 24
#: Lines without a cue that a block may bridge, lines that it takes along on either side, and characters of
#: a block. A longer run of lines is scanned in overlapping blocks, whole.
BRIDGE, MARGIN, BLOCK_CHARS = 8, 3, 16_384
LEVEL = 19
FINDINGS = "array<struct<start:int,end:int,license:string,template:string,reduction:double,wording:double,missing:array<string>,added:array<string>>>"

# Words of a line that may be part of a license.
CUES = (b"licen", b"copyright", b"permission", b"rights reserved", b"warrant", b"redistribut", b"spdx", b"public domain", b"creative commons", b"liab", b"merchantab")
_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*", re.U)
_SIZE = zstandard.ZstdCompressor


def words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0].lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def blocks_of(text: str) -> list[tuple[int, int]]:
    """Start and end of the candidate blocks: lines with a cue, and what they enclose and border on."""
    lines = text.split("\n")
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line) + 1)
    cued = [i for i, line in enumerate(lines) if any(c in low for low in [line.lower().encode("utf-8", "replace")] for c in CUES)]
    runs: list[list[int]] = []
    for i in cued:
        if runs and i - runs[-1][1] <= BRIDGE and len(lines[i]) < BLOCK_CHARS:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    out, done = [], 0
    for k, (i, j) in enumerate(runs):
        after = runs[k + 1][0] if k + 1 < len(runs) else len(lines)
        i, j = max(done, i - MARGIN), min(after, j + MARGIN)
        done, a, b = j, starts[i], starts[j] - 1
        step = BLOCK_CHARS // 2
        out += [(x, min(b, x + BLOCK_CHARS)) for x in range(a, max(a + 1, b - step), step)] if b - a > BLOCK_CHARS else [(a, b)]
    return out


def is_cue(tokens: list[tuple[str, int, int]], k: int) -> bool:
    """Does a cue start in this word?"""
    two = " ".join(w for w, _, _ in tokens[k : k + 2]).encode("utf-8", "replace")
    return any(0 <= two.find(c) < len(tokens[k][0].encode("utf-8", "replace")) for c in CUES)


class Scanner:
    def __init__(self) -> None:
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
        self.templates = []
        for license_, name, text in TEMPLATES:
            body = " ".join(w for w, _, _ in words(text))
            d = zstandard.ZstdCompressionDict(body.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            tool = zstandard.ZstdCompressor(dict_data=d, level=LEVEL, write_content_size=False, write_dict_id=False)
            own = len(self.plain.compress(body.encode())) - len(tool.compress(body.encode()))
            self.templates.append((license_, name, body.split(" "), tool, own))
        short = [len(t[2]) <= NOTICE for t in self.templates]
        self.notices, self.long = ([i for i, x in enumerate(short) if x == y] for y in (True, False))

    def __call__(self, text: bytes | None) -> list[dict]:
        if not text:
            return []
        low = text.lower()
        if not any(c in low for c in CUES):
            return []
        page = text.decode("utf-8", "replace")
        found: list[dict] = []
        for a, b in blocks_of(page):
            found += [f for f in self.block(page[a:b], a) if f not in found]
        return sorted(found, key=lambda f: (f["start"], f["end"]))

    def ranked(self, tokens: list[tuple[str, int, int]], templates: list[int]) -> list[tuple[float, int]]:
        """Reduction and number of the templates, those that save the most bytes first."""
        raw = " ".join(w for w, _, _ in tokens).encode()
        size = len(self.plain.compress(raw))
        saved = [(size - len(self.templates[i][3].compress(raw)), i) for i in templates]
        return [(min(1.0, n / self.templates[i][4]), i) for n, i in sorted(saved, key=lambda x: (-x[0], self.templates[x[1]][4], x[1]))]

    def best(self, tokens: list[tuple[str, int, int]], templates: list[int], offset: int) -> tuple[dict, int, int] | None:
        """The finding of the template that is confirmed best, and its first and last word."""
        tried = [x for x in self.ranked(tokens, templates) if x[0] >= LEAST_REDUCTION][:BEST]
        best = max((self.wording(tokens, i) + (r, i) for r, i in tried), key=lambda x: (x[0] >= LEAST_WORDING, x[4] * x[0], x[0], -x[-1]), default=None)
        if best is None or best[0] < LEAST_WORDING:
            return None
        wording, first, last, (missing, added), _, reduction, i = best
        license_, name = self.templates[i][:2]
        return {"start": offset + tokens[first][1], "end": offset + tokens[last][2], "license": license_, "template": name, "reduction": round(reduction, 4), "wording": round(wording, 4), "missing": missing, "added": added}, first, last

    def block(self, text: str, offset: int) -> list[dict]:
        """The findings of a block: long templates as long as words are left, then notices at each cue."""
        tokens = words(text)
        out: list[dict] = []
        while tokens and (hit := self.best(tokens, self.long, offset)):
            out.append(hit[0])
            tokens = tokens[: hit[1]] + tokens[hit[2] + 1 :]
        k = 0
        while k < len(tokens):
            if not is_cue(tokens, k):
                k += 1
                continue
            at = max(0, k - NEAR)
            hit = self.best(tokens[at : k + NEAR + 1], self.notices, offset)
            if hit:
                out.append(hit[0])
                tokens = tokens[: at + hit[1]] + tokens[at + hit[2] + 1 :]
                k = max(0, at + hit[1] - NOTICE)
            else:
                k += NOTICE  # a notice with a cue up to there was in these words
        return out

    def wording(self, tokens: list[tuple[str, int, int]], i: int) -> tuple:
        """Share of the template's words that the block holds in order, where, and the differences."""
        want, have = self.templates[i][2], [w for w, _, _ in tokens]
        match = SequenceMatcher(None, want, have, autojunk=False)
        same = [m for m in match.get_matching_blocks() if m.size]
        held = sum(m.size for m in same)
        if not same:
            return 0.0, 0, 0, ([], []), 0
        first, last = same[0].b, same[-1].b + same[-1].size - 1
        missing = [w for tag, a, b, _, _ in match.get_opcodes() if tag in ("delete", "replace") for w in want[a:b]]
        added = [w for tag, _, _, a, b in match.get_opcodes() if tag in ("insert", "replace") for w in have[max(a, first) : min(b, last + 1)]]
        return held / len(want), first, last, (missing, added), held


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` (with text) plus findings (a column of this name is replaced): spans of the text, license, template, reduction,
    share of the template's wording, and the words that are missing or added.

    Defined cases: a null or empty text, or one without a cue, has no findings; overlapping blocks
    report a finding once; repeated rows give equal findings; an empty table gives an empty result.
    """
    return docs.withColumn("findings", text_udf(FINDINGS, Scanner)("text"))


def summary(docs: DataFrame) -> DataFrame:
    """``docs`` plus findings, n_findings and licenses (distinct, sorted, joined by commas); columns of
    these names are replaced."""
    out = scanned(docs)
    return out.withColumns({"n_findings": F.size("findings").cast("long"), "licenses": F.array_join(F.array_sort(F.array_distinct("findings.license")), ",")})
