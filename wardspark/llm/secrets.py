"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

Text that people write needs few tokens for its length; a random string needs a token for every one or two
characters. Candidates are runs of key characters with a letter; one whose characters per token under a tiktoken
vocabulary fall below a limit is reported as ``rare``, unless it is a digest or a UUID. For runs that look like words
joined by signs the limit is stricter, and capitals are read as small letters where the shape is one of words; runs of
12 to 15 characters must have digits between letters and meet a stricter limit still, as they offer less evidence. Words
joined to a key by signs (names, paths) dilute the average of the run; so where the run as a whole stays above the
limit, its stretches are tested, and those below the limit are reported.

Defined cases: a null text counts as empty and has no span; repeated rows are scanned each on its own; spans of
different kinds may overlap, spans of one kind may not; extra columns are ignored by the scan and kept by ``redact``.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardspark.llm.common import arrow_map, table

#: Kinds of the base patterns, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "rare")

ASSIGN = re.compile(
    r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")

CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{12,}")
#: Lengths in hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = frozenset({32, 40, 56, 64, 96, 128})
UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: The shape of identifiers: words in camel or snake case with at most a few digits at the end of each.
IDENTIFIER = re.compile(r"[_/=+-]*(?:[A-Za-z]{3,}[0-9]{0,4}[_/=+-]+)*[A-Za-z]{3,}[0-9]{0,4}[_/=+-]*")
MAX_CHARS_PER_TOKEN = 2.0
#: The limit as a share of the other for what has this shape and several words, or is cut out of a word.
SHAPED_SHARE = 0.9
SHORTEST = 16
#: The limit as a share of the other for runs shorter than that.
SHORT_SHARE = 0.75
SIGNS = "=-_/+"
#: Inside a run, what is never part of a stretch: UUIDs, and hex digits of a digest's length.
EXEMPT = re.compile(
    rf"(?<![A-Za-z0-9])(?:{UUID.pattern}|"
    + "|".join(f"[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}" for n in sorted(DIGEST_LENGTHS))
    + ")(?![A-Za-z0-9])"
)
_DIGIT_INSIDE = re.compile(r"[A-Za-z][0-9]+[A-Za-z]")
#: Parts of a run of at most so many characters go with the stretch beside them.
SHORT_PART = 3

SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_rare long"


def tiktoken_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Scanner:
    """``vocabulary``: path of a tiktoken rank file, which every executor can read."""

    def __init__(self, vocabulary: str, limit: float = MAX_CHARS_PER_TOKEN):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.limit = limit

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, rank of the kind, end) of the fixed patterns."""
        found = []
        if KEYWORD.search(text):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
        return found

    def rare(self, text: str) -> list[tuple[int, int, int]]:
        found = []
        for m in CANDIDATE.finditer(text):
            word = m.group()
            if len(word) < SHORTEST:
                if _DIGIT_INSIDE.search(word) and self.is_random(word, SHORT_SHARE):
                    found.append((m.start(), 3, m.end()))
            elif self.is_random(word):
                found.append((m.start(), 3, m.end()))
            elif len(word) > SHORTEST:
                at = 0
                for a, b in [*(x.span() for x in EXEMPT.finditer(word)), (len(word), len(word))]:
                    found += [(m.start() + at + x, 3, m.start() + at + y) for x, y in self.stretches(word[at:a])]
                    at = b
        return found

    def stretches(self, word: str) -> list[tuple[int, int]]:
        """Random stretches inside ``word``, widened to the signs around them and over short parts: first the one that
        saves most tokens against the limit, then those to its left and right."""
        if len(word) < SHORTEST:
            return []
        ends, gains = [0], [0.0]
        for token in self.encoding.encode_ordinary(word):
            size = len(self.encoding.decode_single_token_bytes(token))
            ends.append(ends[-1] + size)
            piece = word[ends[-2] : ends[-1]]
            gains.append(gains[-1] + (self.limit - size if piece.strip(SIGNS) else 0.0))
        found, ranges = set(), [(0, len(ends) - 1)]
        while ranges:
            low, high = ranges.pop()
            best, k, least = (0.0, 0, 0), low, low
            for j in range(low + 1, high + 1):
                while ends[j] - ends[k] >= SHORTEST:
                    least = k if gains[k] < gains[least] else least
                    k += 1
                if k > low:
                    best = max(best, (gains[j] - gains[least], least, j))
            gain, i, j = best
            if gain > 0:
                a, b = self.widened(word, ends[i], ends[j])
                if b - a >= SHORTEST and (
                    self.is_random(word[a:b])
                    or not (IDENTIFIER.fullmatch(word, a, b) and not word[a:b].isalnum())
                    and self.is_random(word[ends[i] : ends[j]], cut=True)
                ):
                    found.add((a, b))
                ranges += [(low, i), (j, high)]
        out: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if out and a < out[-1][1]:
                a, b = out[-1][0], max(b, out.pop()[1])
            out.append((a, b))
        return out

    @staticmethod
    def widened(word: str, a: int, b: int) -> tuple[int, int]:
        """The parts between signs that ``word[a:b]`` touches, and short ones beside them."""
        while a < b and word[a] in SIGNS:
            a += 1
        while a < b and word[b - 1] in SIGNS:
            b -= 1
        parts = [m.span() for m in re.finditer(r"[A-Za-z0-9]+", word)]
        touched = [k for k, (x, y) in enumerate(parts) if x < b and a < y]
        if not touched:
            return a, a
        i, j = touched[0], touched[-1]
        while i and parts[i - 1][1] - parts[i - 1][0] <= SHORT_PART:
            i -= 1
        while j + 1 < len(parts) and parts[j + 1][1] - parts[j + 1][0] <= SHORT_PART:
            j += 1
        return parts[i][0], parts[j][1]

    def is_random(self, word: str, share: float = 1.0, cut: bool = False) -> bool:
        core = word.strip(SIGNS)
        if not any(c.isalpha() for c in core):
            return False
        if len(core) in DIGEST_LENGTHS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", core):
            return False
        if UUID.fullmatch(core):
            return False
        shaped = IDENTIFIER.fullmatch(core) or not any(c.isdigit() for c in core)
        limit = self.limit * share * (SHAPED_SHARE if shaped and (cut or not core.isalnum()) else 1)
        return len(core) < limit * len(self.encoding.encode_ordinary(core.lower() if shaped and core.isupper() else core))

    def spans(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        return sorted(self.base(text)), sorted(self.rare(text))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(docs: DataFrame, vocabulary: str | None = None, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """One row per document: counts by kind, a digest of the base spans, and all spans (code points, end exclusive)."""
    vocabulary = vocabulary or tiktoken_file()
    kept: dict[str, Scanner] = {}

    def rows(x: dict) -> dict:
        scanner = kept.get("scanner") or kept.setdefault("scanner", Scanner(vocabulary, limit))
        out: dict[str, list] = {n: [] for n in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_rare")}
        for text in x["text"]:
            base, rare = scanner.spans(text or "")
            for k, name in enumerate(("n_assign", "n_access", "n_hex")):
                out[name].append(sum(s[1] == k for s in base))
            out["base_sha256"].append(hashlib.sha256(written(base).encode()).hexdigest())
            out["spans"].append(written(base + rare))
            out["n_rare"].append(len(rare))
        return {"doc_id": x["doc_id"], **out}

    return arrow_map(docs.select(F.col("doc_id").cast("long"), "text"), SCHEMA, rows)


def redact(docs: DataFrame, vocabulary: str | None = None, limit: float = MAX_CHARS_PER_TOKEN) -> DataFrame:
    """The same rows and columns, each secret in ``text`` replaced by ``[SECRET]``; ``n_chars`` follows the text."""
    vocabulary = vocabulary or tiktoken_file()
    kept: dict[str, Scanner] = {}

    def clean(scanner: Scanner, text: str | None) -> str | None:
        if not text:
            return text
        base, rare = scanner.spans(text)
        out, at = [], 0
        for a, _, b in sorted(base + rare):
            if a >= at:
                out += [text[at:a], "[SECRET]"]
            at = max(at, b)
        return "".join(out) + text[at:] if out else text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept.get("scanner") or kept.setdefault("scanner", Scanner(vocabulary, limit))
        for batch in batches:
            k = batch.schema.get_field_index("text")
            columns = list(batch.columns)
            columns[k] = pa.array([clean(scanner, t) for t in columns[k].to_pylist()], batch.schema.field(k).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    made = docs.mapInArrow(run, docs.schema)
    return made.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else made


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents", "doc_id", "text"))
