"""Secret scans: three base patterns, and dictionary-primed zstandard novelty.

The method adds to the base patterns the strings that stand near a sensitive word and that a compressor primed with
the code around them and a dictionary of identifiers cannot shorten: names, paths and words reuse what is already
there, keys do not. The measure is the bytes that the candidate adds to a frame, against those that random characters of its alphabet take.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from dataclasses import dataclass
from functools import lru_cache

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField

from tracelake.llm.common import map_texts

#: The base patterns, in the order that sorts equal starts, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "novel")

#: Words that make a context sensitive, in lower case.
SENSITIVE = ("key", "secret", "token", "passw", "pwd", "credential", "bearer", "authorization", "private", "signature")
CANDIDATE = re.compile(r"(?:[A-Za-z0-9+/_=$!@#%^&*~-]|\.(?=[A-Za-z0-9])){16,}")
PARTS = re.compile(r"[^A-Za-z0-9]+")
#: Letters of a word at most.
LONGEST_WORD = 24
#: Characters before a candidate that must hold a sensitive word, characters around it that prime the compressor, the
#: least share of new bytes in its characters, their least number, and the share, of the bytes that random characters of
#: its alphabet take, from which on it is new anyway.
BEFORE, AROUND, LEAST_SHARE, LEAST_BYTES, RANDOM_SHARE = 40, 2_000, 0.8, 14, 0.9
#: Random characters that are drawn at most: the bytes of more are in proportion.
DRAWN = 20_000
#: What may stand between a candidate and the next one that continues it: ends of lines, quotes, the dots of a token.
CONTINUES = re.compile(r"""(?:\s|\\[nrt]|["'`+,.;\\>|#*]){1,40}""")
#: Identifiers that are frequent in code and configuration.
IDENTIFIERS = (
    "access account address algorithm application argument array attribute authentication authorization base64 boolean buffer bytes cache callback "
    "certificate class client column command config connection constant container content context controller cookie count create credentials "
    "database default definition delete description destination device directory document domain element encoding encryption endpoint engine "
    "environment error event example exception expression extension factory false field filename filter float format function generator get_ "
    "handler header hostname http https identifier implementation import index information instance integer interface iterator kernel language "
    "length library listener local location manager master memory message metadata method model module network node null number object "
    "operation option output package parameter parent password path pattern permission pointer policy port position prefix private process "
    "production property protocol provider public query queue random record reference registry repository request resource response result "
    "return role schema script secret section security select self sequence server service session set_ signature source static status storage "
    "stream string structure table target template test_ thread timestamp token transaction true type update upload username utility validate "
    "value variable vector version virtual void widget window workspace wrapper abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789"
)


def alphabet(s: str) -> str:
    """The characters that ``s`` may be drawn from: whole classes but for those with a few of its letters only, as a prefix has."""
    out = string.digits + "".join(sorted({c for c in s if not c.isalnum()}))
    for letters in (string.ascii_lowercase, string.ascii_uppercase):
        own = [c for c in s if c in letters]
        hexes = sum(c in letters[:6] for c in own)
        wide = letters if len(own) > 0.05 * len(s) else ""
        out += letters[:6] if wide and hexes >= 0.9 * len(own) else wide
    return out


@lru_cache(4_096)
def random_bytes(characters: str, size: int) -> float:
    """Bytes of a frame over ``size`` random characters, the least of three draws, the same on each run."""
    if size > DRAWN:
        return random_bytes(characters, DRAWN) * size / DRAWN
    draw, packer = random.Random(size), zstandard.ZstdCompressor(level=19, write_content_size=False)
    return min(len(packer.compress("".join(draw.choices(characters, k=size)).encode())) for _ in range(3)) - len(packer.compress(b""))


@dataclass
class Novelty:
    """Marginal compressed bytes against a dictionary of identifiers and the text around a candidate.

    With ``repeats`` a string that occurs again nearby is a name, and not new. Without, its other occurrences are left out
    of what primes the compressor, so that a key that stands in a text several times is found each time.
    """

    identifiers: str = IDENTIFIERS
    repeats: bool = True

    def _around(self, text: str, start: int, end: int) -> tuple[str, str]:
        """AROUND characters on each side. Without ``repeats`` other occurrences are left out, those that a side's far end cuts too."""
        candidate, size, lo, hi = text[start:end], end - start, max(0, start - AROUND), end + AROUND
        if self.repeats:
            return text[lo:start], text[end:hi]
        if (cut := text.find(candidate, max(0, lo - size + 1), min(start, lo + size - 1))) >= 0:
            lo = cut
        if (cut := text.find(candidate, max(end, hi - size + 1), hi + size - 1)) >= 0:
            hi = cut + size
        return text[lo:start].replace(candidate, " "), text[end:hi].replace(candidate, " ")

    def added(self, text: str, start: int, end: int) -> int:
        candidate, (before, after) = text[start:end], self._around(text, start, end)
        prime = f"{self.identifiers} {self.identifiers.upper()} {after} {before}".encode("utf-8", "replace")
        packer = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(prime, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False)
        return len(packer.compress(candidate.encode())) - len(packer.compress(b""))

    def novel(self, text: str, start: int, end: int) -> bool:
        """Whether the whole candidate, however long, is new to its surroundings."""
        candidate = text[start:end]
        # A long random string takes less than a byte a character, as its alphabet is limited.
        least = min(LEAST_SHARE * len(candidate), RANDOM_SHARE * random_bytes(alphabet(candidate), len(candidate)))
        return self.added(text, start, end) >= max(LEAST_BYTES, least)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns' matches, in code points, each kind leftmost and not overlapping itself."""
    low = text.lower()
    out = []
    if any(w in low for w in ASSIGN_WORDS):
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    out += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return out


def _named(s: str) -> bool:
    """Whether words make up most of a string, as in names and paths: parts of at most LONGEST_WORD letters alone in the case of a word."""
    return sum(len(p) + 1 for p in PARTS.split(s) if 2 < len(p) <= LONGEST_WORD and p.isalpha() and (p.islower() or p.isupper() or p.istitle())) > 0.6 * len(s)


def novel_spans(text: str, taken: list[tuple[int, int, str]], novelty: Novelty) -> list[tuple[int, int, str]]:
    """Candidates near a sensitive word that no base span touches and that are new to what surrounds them: 16 characters or more of CANDIDATE in a row that words do
    not make up for the most part, of letters, digits or both.

    A candidate that directly follows one near a sensitive word, as the next line of a key does, counts as near it too.
    """
    low = text.lower()
    if not any(w in low for w in SENSITIVE):
        return []
    out, busy, at, sensitive, last = [], sorted(taken), 0, False, 0
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        while at < len(busy) and busy[at][1] <= start:
            at += 1
        near = text[max(0, start - BEFORE) : start].lower()
        sensitive = any(w in near for w in SENSITIVE) or (sensitive and CONTINUES.fullmatch(text, last, start) is not None)
        last = end
        if any(s < end and e > start for s, e, _ in busy[at : at + 3]) or not sensitive or _named(m[0]):
            continue
        if novelty.novel(text, start, end):
            out.append((start, end, "novel"))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, counts ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` and ``spans`` of every row.

    ``spans`` holds kind:start:end of all spans, ``base_sha256`` the digest of the same list without the method's own
    (kind novel). Positions are code points of the whole text, the end exclusive. Null counts as empty: no span. Rows
    with a null id and repeated rows each come out; other columns are not read. An empty table gives an empty result.
    """
    novelty = Novelty(repeats=False)

    def run(texts: list[str]) -> list[list]:
        out: list[list] = [[], [], [], [], []]
        for t in texts:
            base = base_spans(t)
            for column, kind in zip(out, KINDS[:3], strict=False):
                column.append(sum(s[2] == kind for s in base))
            out[3].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out[4].append(joined(base + novel_spans(t, base, novelty)))
        return out

    fields = [StructField(n, LongType()) for n in ("n_assign", "n_access", "n_hex")] + [StructField(n, StringType()) for n in ("base_sha256", "spans")]
    return map_texts(docs, [id_col], text_col, fields, run)
