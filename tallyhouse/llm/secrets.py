"""Secrets in text: fixed patterns, and strings that a primed compressor finds novel.

Besides the patterns, candidates are long strings near a word such as ``key`` or ``auth``.
Each is compressed twice with zstandard, primed with a dictionary of identifiers and common
words: the text around it alone, and with the candidate put in. The growth, its marginal
size, is small for prose, identifiers and repeats of the surroundings, and close to the
string's own entropy for keys. Incompressible candidates are reported as ``novel``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.llm.common import map_texts, text_of

# The kinds in the order in which ties are listed, and their patterns.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs: the shorter ones would be dropped
ASSIGN_VALUE, ACCESS_LENGTH = 12, 18

_FIELDS = ("start", "kind_rank", "end", "kind")
SPANS = "array<struct<start:int,kind_rank:int,end:int,kind:string>>"
CONTEXT = re.compile(
    r"(?i:secret|passw|passphrase|token|api_?key|private|credential|auth|bearer|signature|access)", re.ASCII
)
CANDIDATE_LENGTH = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_LENGTH},}}")
_OF_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]")
# Words and identifiers that code and its comments are full of: what is not novel.
IDENTIFIERS = """
the of and to in is was for on with that this from http https www com org example localhost
import export return function class public private static final void string int long boolean
true false null none self this new def var let const if else for while try except catch raise
throw finally lambda async await yield print printf println format include define struct
namespace template typename interface implements extends package module require exports
get set put post delete update insert select where from join group order limit values table
user name username password passwd passphrase secret token access refresh bearer auth
authorization authentication credential credentials private public key keys apikey api_key
api-key client client_id client_secret session cookie config configuration settings env
environment getenv process parse parser json yaml xml html utf base64 encode decode encrypt
decrypt hash digest signature sign verify certificate BEGIN END RSA PRIVATE KEY CERTIFICATE
request response header headers body content type application accept server host port
path file filename directory folder read write open close stream buffer index length size
count total value values result results error exception message status code data database
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef
"""


@dataclass(frozen=True)
class Novelty:
    """Which candidates are reported: those in reach of a context word whose marginal size is
    at least ``least`` bytes per character.

    ``reach`` is how many characters may lie between the word and the string behind or before
    it, less one; ``around`` is how many characters on each side serve as surroundings.
    """

    reach: int = 48
    around: int = 256
    least: float = 0.72


class Scanner:
    """Finds the spans ``(start, kind's place, end, kind)`` of one text after another."""

    def __init__(self, novelty: Novelty):
        self.novelty = novelty
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False)

    def spans(self, text: str) -> list[tuple[int, int, int, str]]:
        contexts = list(CONTEXT.finditer(text))  # every assignment starts with one
        assigned = ASSIGN.finditer(text) if contexts else ()
        found = [(m.start(), 0, m.end()) for m in assigned if len(m[2]) >= ASSIGN_VALUE]
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        covered = sorted((start, end) for start, _, end in found)
        found += [(start, 3, end) for start, end in self._novel(text, contexts, covered)]
        return [(start, kind, end, KINDS[kind]) for start, kind, end in sorted(found)]

    def _novel(
        self, text: str, contexts: list[re.Match], covered: list[tuple[int, int]]
    ) -> Iterator[tuple[int, int]]:
        """Novel strings outside the spans found by pattern."""
        upto, at = 0, 0
        for context in contexts:
            for m in self._near(text, context, upto):
                upto = m.end()
                while at < len(covered) and covered[at][1] <= m.start():
                    at += 1
                if at < len(covered) and covered[at][0] < m.end():
                    continue
                if self.is_novel(text, m.start(), m.end()):
                    yield m.span()

    def _near(self, text: str, context: re.Match, upto: int) -> Iterator[re.Match]:
        """Candidates from ``upto`` on that end or start in reach of a context word, in order."""
        start = max(upto, context.start() - self.novelty.reach)
        while start > upto and _OF_CANDIDATE.match(text, start - 1):  # the whole run
            start -= 1
        yield from CANDIDATE.finditer(text, start, max(start, context.start()))
        start, edge = max(upto, context.end()), context.end() + self.novelty.reach
        while (m := CANDIDATE.search(text, start, edge + CANDIDATE_LENGTH - 1)) is not None:
            m = CANDIDATE.match(text, m.start())  # the whole run, also beyond the edge
            start = m.end()
            yield m

    def is_novel(self, text: str, start: int, end: int) -> bool:
        return self.marginal(text, start, end) >= self.novelty.least * (end - start)

    def marginal(self, text: str, start: int, end: int) -> int:
        """Bytes by which the compressed surroundings grow when the candidate is put in."""
        before, after = text[max(0, start - self.novelty.around) : start], text[end : end + self.novelty.around]
        sizes = [
            len(self.compressor.compress(s.encode("utf-8", "surrogatepass")))
            for s in (before + after, before + text[start:end] + after)
        ]
        return sizes[1] - sizes[0]


def find_secrets(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", novelty: Novelty | None = None
) -> DataFrame:
    """One row per row: ``id`` and ``spans``, an array of ``(start, kind_rank, end, kind)``.

    Positions are code points, ``end`` exclusive. Spans are sorted by start, then kind; of
    one kind they do not overlap, and ``novel`` ones overlap no other. NULL text is empty
    and has none. Whole texts are read, in one pass without a shuffle; other columns are
    ignored, repeated rows are scanned each, and an empty table gives no row.
    """
    rows = docs.select(F.col(id_column).alias("id"), text_of(text).alias("text"))
    chosen = novelty or Novelty()

    def make():
        scanner = Scanner(chosen)
        return lambda texts: [[[dict(zip(_FIELDS, s)) for s in scanner.spans(t)] for t in texts]]

    return map_texts(rows, make, f"spans {SPANS}")
