"""Secret scan: candidates by form, false positives removed by a random forest.

Candidates are runs of key characters that hold a digit, and values assigned to a word such as password or token. The
forest judges each by its length and characters, the transitions between them, how much of it a dictionary covers,
whether it stands in a path or address, and the words beside it.

No table of labelled findings comes with the documents. They are derived from every one of them: keys in the forms that
services and settings use, drawn from hashes of the document and set between its words, are findings; names, paths,
addresses, versions, dates and checksums made of its words and hashes are false positives. ``fit`` takes any labelled
table (text, first, after, label, words) in their place. The dictionary counts the letters of all words of all texts, and
the forest is Spark's over the features of all findings. Every text is scanned whole.

Defined cases: null and empty texts have no candidates, and their findings are made of a fixed word; overlapping candidates
are joined; repeated rows each come out; other columns are kept; without documents to learn from a fixed set of made findings
over a few words is used.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.helpers import process_store, spoonfuls
from orrery.session import fresh_path, rewritten

# Letters of a word that the dictionary counts, and different letter groups that a task holds at once.
LEAST_WORD, MOST_WORD, HELD_GROUPS = 2, 20, 500_000
TREES, DEPTH, LEAST_LEAF, CUTS = 25, 8, 4, 64
THRESHOLD = 0.5
MASK = "[SECRET]"

RUN = re.compile(r"(?<![A-Za-z0-9+/_\-])[A-Za-z+/_\-]*+[0-9][A-Za-z0-9+/_\-]*+={0,2}")
LEAST_RUN = 8
KEY_WORDS = r"passw(?:or)?d|passwd|pwd|secret|token|api[_\-]?key|access[_\-]?key|private[_\-]?key|client[_\-]?key|auth|bearer|credentials?"
ASSIGNED = re.compile(rf"(?:{KEY_WORDS})[\w\-]*[\"']?\s*(?:[:=]|=>)\s*[\"']?([^\s\"',;<>]{{6,}})", re.I)
NEAR_KEY = re.compile(rf"(?:{KEY_WORDS})[\w\-]*\W*(?:\w+\W+)?\Z", re.I)
NEAR_HARMLESS = re.compile(r"\b(?:commit|sha|sha1|sha256|md5|checksum|digest|hash|revision|version|uuid|id|build|release|model|part|page|order|invoice)\W*\Z", re.I)
SERVICE = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|glpat-|xox[abprs]-|sk[-_](?:live|test)?|rk_live|SG\.|ya29|eyJ|npm_|pypi-)")
ADDRESS = re.compile(r"https?://\S*\Z", re.I)
ANY_KEY = re.compile(KEY_WORDS, re.I)
PLAIN, LETTERS, HEX, NUMBER = re.compile(r"[^A-Za-z]"), re.compile(r"[a-z]+"), re.compile(r"[0-9a-f]+|[0-9A-F]+"), re.compile(r"[0-9_\-+/.=]+")


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Places of what may be a secret, in order and apart."""
    if not text:
        return []
    found = [m.span() for m in RUN.finditer(text) if m.end() - m.start() >= LEAST_RUN]
    if "=" in text or ":" in text:
        found += [m.span(1) for m in ASSIGNED.finditer(text)]
    out: list[tuple[int, int]] = []
    for first, after in sorted(found):
        if out and first < out[-1][1]:
            out[-1] = (out[-1][0], max(after, out[-1][1]))
        else:
            out.append((first, after))
    return out


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Whether each code point is white space, and whether it is a letter; made once per worker."""
    held = process_store("secrets_letters")
    if not held:
        for name, test in (("white", str.isspace), ("letter", str.isalpha)):
            held[name] = np.fromiter((test(chr(c)) for c in range(0x110000)), bool, 0x110000)
    return held["white"], held["letter"]


def letter_groups(texts: list[str | None]) -> Counter:
    """Numbers of the letter pairs and threes of the texts' words; the ends of a word are blanks, and stand in pairs alone."""
    white, letter = _classes()
    u = _points("\n".join(t for t in texts if t).lower())
    blank = white[u]
    sizes = np.diff(np.flatnonzero(blank), prepend=-1, append=len(u)) - 1
    size = np.repeat(sizes, sizes + 1)[: len(u)]
    kept = blank | (letter[u] & (size >= LEAST_WORD) & (size <= MOST_WORD))
    seq = np.zeros(np.count_nonzero(kept) + 2, np.int32)
    seq[1:-1] = np.where(blank[kept], 0, u[kept])
    seq = seq[(seq != 0) | np.concatenate(([True], seq[:-1] != 0))]
    if len(seq) < 2:
        return Counter()
    present = np.flatnonzero(np.bincount(seq))
    n, names = len(present), [chr(c) if c else " " for c in present]
    at = np.zeros(present[-1] + 1, np.int32 if n <= 1000 else np.int64)
    at[present] = np.arange(n)
    codes = at[seq]
    pairs = codes[:-1] * n + codes[1:]
    inner = (codes[:-2] > 0) & (codes[1:-1] > 0) & (codes[2:] > 0)
    threes = (pairs[:-1] * n + codes[2:])[inner]
    out: Counter = Counter()
    for group, length in ((pairs, 2), (threes, 3)):
        if n**length <= 1 << 22:
            counts = np.bincount(group, minlength=1)
            codes_of = np.flatnonzero(counts)
            counts = counts[codes_of]
        else:
            codes_of, counts = np.unique(group, return_counts=True)
        for code, count in zip(codes_of.tolist(), counts.tolist()):
            letters = []
            for _ in range(length):
                code, c = divmod(code, n)
                letters.append(names[c])
            out["".join(reversed(letters))] = count
    return out


class Dictionary:
    """Letter pairs and threes of ordinary words, from their numbers (``letter_groups``)."""

    def __init__(self, groups: dict[str, int]):
        self.threes = {g for g in groups if len(g) == 3}
        pairs = {(g[0], g[1]): n for g, n in groups.items() if len(g) == 2}
        firsts: Counter = Counter()
        for p, n in pairs.items():
            firsts[p[0]] += n
        self.pairs = {p: math.log((n + 0.5) / (firsts[p[0]] + 20)) for p, n in pairs.items()}
        # The same for look-ups of many values at once: sorted codes.
        logs = sorted((_code("".join(p)), v) for p, v in self.pairs.items())
        self.pair_codes, self.pair_logs = np.array([c for c, _ in logs], np.int64), np.array([v for _, v in logs], float)
        self.three_codes = np.array(sorted(map(_code, self.threes)), np.int64)

    @staticmethod
    def of(texts: DataFrame) -> "Dictionary":
        """From all words of a table of texts (text)."""

        def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: Counter = Counter()
            for some in spoonfuls((t for frame in frames for t in frame["text"]), 2_000_000):
                total.update(letter_groups(some))
                if len(total) > HELD_GROUPS:
                    yield pd.DataFrame(total.items(), columns=["letters", "n"])
                    total.clear()
            yield pd.DataFrame(total.items(), columns=["letters", "n"]).astype({"n": np.int64})

        found = texts.select("text").mapInPandas(count, "letters string, n long").groupBy("letters").agg(F.sum("n").alias("n"))
        return Dictionary({r["letters"]: r["n"] for r in found.collect()})

    def judged(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Per value the share of the characters that lie in a letter triple of the dictionary, and the mean log probability of the
        transitions between characters."""
        low = [v.lower() for v in values]
        sizes = np.fromiter(map(len, low), np.int64, len(low))
        # One blank ends a value and begins the next one.
        u = _points(f" {' '.join(low)} ").astype(np.int64)
        row = np.repeat(np.arange(len(low)), sizes + 1)
        pairs = (u[:-1] << 21) | u[1:]
        logs = np.full(len(pairs), -7.0)
        at, found = _looked_up(pairs, self.pair_codes)
        logs[found] = self.pair_logs[at[found]]
        hits = np.zeros(len(u) + 2, bool)
        hits[2 : len(u)] = _looked_up((pairs[:-1] << 21) | u[2:], self.three_codes)[1]
        covered = hits[2:] | hits[1:-1] | hits[:-2]
        return np.bincount(row, covered[1:], len(low)) / sizes, np.bincount(row, logs, len(low)) / (sizes + 1)


def _code(letters: str) -> int:
    code = 0
    for c in letters:
        code = code << 21 | ord(c)
    return code


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _looked_up(codes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a sorted array, and whether they hold the codes."""
    if not len(known):
        return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
    at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
    return at, known[at] == codes


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.isalpha() else 3


def _kinds() -> np.ndarray:
    """The kind of each code point; made once per worker."""
    held = process_store("secrets_kinds")
    if not held:
        held["kind"] = np.fromiter((kind(chr(c)) for c in range(0x110000)), np.int8, 0x110000)
    return held["kind"]


def feature_rows(texts: list[str], places: list[tuple[int, int]], known: Dictionary) -> np.ndarray:
    """Features of many candidates (first, after), each in its text; none may be empty."""
    values = [t[a:b] for t, (a, b) in zip(texts, places)]
    out = np.zeros((len(values), N_FEATURES))
    if not values:
        return out
    rows, n = len(values), np.fromiter(map(len, values), np.int64, len(values))
    u, row = _points("".join(values)), np.repeat(np.arange(rows), n)
    kinds = _kinds()[u]
    out[:, 0] = n
    for j, one in ((1, 0), (2, 1), (3, 3)):
        out[:, j] = np.bincount(row, kinds == one, rows) / n
    out[:, 4] = np.bincount(row[1:], (kinds[1:] != kinds[:-1]) & (row[1:] == row[:-1]), rows) / n
    held, counts = np.unique(row << 21 | u, return_counts=True)
    of = held >> 21
    shares = counts / n[of]
    out[:, 5] = -np.bincount(of, shares * np.log2(shares), rows)
    out[:, 6] = np.maximum.reduceat(counts, np.searchsorted(of, np.arange(rows))) / n
    out[:, 7], out[:, 8] = known.judged(values)
    for i, (text, (first, after), value) in enumerate(zip(texts, places, values)):
        before, behind, low = text[max(0, first - 48) : first], text[after : after + 8], value.lower()
        around = before + value + behind[:1]
        letters = max(1, sum(map(str.isalpha, low)))
        out[i, 9:] = (
            max(map(len, LETTERS.findall(low)), default=0) / len(value),
            sum(map(low.count, "aeiou")) / letters,
            bool(HEX.fullmatch(value)),
            bool(NUMBER.fullmatch(value)),
            value.count("/") + value.count(".") > 1 or before.endswith(("/", "\\")) or behind[:1] in ("/", "\\"),
            "@" in around or ("://" in around and bool(ADDRESS.search(around))) or behind[:1] == "@",
            before.rstrip(" \"'").endswith(("=", ":", ">")),
            bool(ANY_KEY.search(before) and NEAR_KEY.search(before)),
            bool(NEAR_HARMLESS.search(before)),
            bool(SERVICE.match(value)),
        )
    return out


def features(text: str, first: int, after: int, known: Dictionary) -> list[float]:
    return feature_rows([text], [(first, after)], known)[0].tolist()


N_FEATURES = 19


class Forest:
    """Random forest for two classes; a tree is arrays of feature, cut, children and share of findings."""

    def __init__(self, trees: list[list[np.ndarray]]):
        self.trees = trees

    @staticmethod
    def grown(table: DataFrame, seed: int = 5) -> "Forest":
        """Spark's forest over all rows of a table (x0, x1, ..., label)."""
        names = [c for c in table.columns if c != "label"]
        some = math.isqrt(len(names)) + 1
        rows = VectorAssembler(inputCols=names, outputCol="x").transform(table).select("x", "label")
        grower = RandomForestClassifier(
            featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=LEAST_LEAF, maxBins=CUTS,
            featureSubsetStrategy=str(some), seed=seed,
        )
        path = fresh_path(table.sparkSession, "forest")
        grower.fit(rows).save(path)
        nodes: dict[int, list] = {}
        # At most 2^(DEPTH + 1) nodes per tree.
        for r in table.sparkSession.read.parquet(f"{path}/data").collect():
            nodes.setdefault(r["treeID"], []).append(r["nodeData"])
        trees = []
        for own in nodes.values():
            own = sorted(own, key=lambda d: d["id"])
            cuts = [(d["split"]["featureIndex"], d["split"]["leftCategoriesOrThreshold"][0]) if d["leftChild"] >= 0 else (-1, 0.0) for d in own]
            shares = [d["impurityStats"][1] / sum(d["impurityStats"]) if len(d["impurityStats"]) > 1 else 0.0 for d in own]
            rows_of = [(f, cut, max(d["leftChild"], 0), max(d["rightChild"], 0), share) for (f, cut), d, share in zip(cuts, own, shares)]
            trees.append(list(np.array(rows_of, dtype=float).T))
        return Forest(trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of findings in the leaves that a row falls into."""
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH + 1):
                f = feature[at].astype(np.int64)
                inner = f >= 0
                lower = x[np.arange(len(x)), np.maximum(f, 0)] <= cut[at]
                at = np.where(inner, np.where(lower, left[at], right[at]).astype(np.int64), at)
            total += share[at]
        return total / len(self.trees)


class Scanner:
    """A fitted forest with its dictionary."""

    def __init__(self, forest: Forest, known: Dictionary):
        self.forest, self.known = forest, known

    def scan(self, texts: list[str | None]) -> list[list[tuple[int, int, float]]]:
        """(first, after, score) of the candidates of each text."""
        places = [candidates(t) for t in texts]
        rows = feature_rows([t for t, own in zip(texts, places) for _ in own], [p for own in places for p in own], self.known)
        scores = iter(self.forest.predict(rows).tolist())
        return [[(a, b, next(scores)) for a, b in own] for own in places]


def made_findings(words: list[str], seed: str) -> list[tuple[str, str, str, int]]:
    """(before, value, behind, label): findings and false positives made of a document's words and its hash."""
    rng = random.Random(seed)
    hexes = hashlib.sha512(seed.encode()).hexdigest()
    mixed = re.sub(r"[^A-Za-z0-9]", "", base64.b64encode(hashlib.sha512((seed + "x").encode()).digest()).decode())
    upper = base64.b32encode(hashlib.sha256((seed + "y").encode()).digest()).decode().rstrip("=")
    plain: list[str] = []

    def pick() -> str:
        """A word with a letter, without its other characters."""
        for _ in range(0 if plain or not words else 20):
            word = rng.choice(words)
            if LEAST_WORD <= len(word) <= MOST_WORD and (word := PLAIN.sub("", word)):
                return word
        if not plain:
            plain.extend([w for w in (PLAIN.sub("", w) for w in words if LEAST_WORD <= len(w) <= MOST_WORD) if w] or ["word"])
        return rng.choice(plain)

    lead, tail = f"{pick()} {pick()} ", f" {pick()} {pick()}."
    key = rng.choice(["password", "passwd", "token", "secret", "api_key", "apiKey", "access_key", "auth_token", "client_secret", "PASSWORD", "pwd"])
    sign = rng.choice(["=", " = ", ": ", ":", "="])
    quote = rng.choice(["", '"', "'"])
    n = rng.randrange(12, 48)
    value = rng.choice([hexes[:n], mixed[:n], hexes[: n - 4] + pick()[:3] + "!9", mixed[:n] + "=="])
    prefix = rng.choice(["AKIA", "ASIA", "AIza", "ghp_", "glpat-", "xoxb-", "sk-", "sk_live_", "npm_"])
    body = upper[:16] if prefix.startswith("A") and prefix != "AIza" else mixed[: rng.randrange(24, 40)]
    address = f"{pick().lower()}.{rng.randrange(100)}{rng.choice(['', pick().lower()])}"
    return [
        (f"{lead}{key}{sign}{quote}", value, f"{quote}{tail}", 1),
        (lead, prefix + body, tail, 1),
        (f"{lead}{rng.choice(['Bearer ', 'Authorization: Bearer ', 'credentials: ', 'secret '])}", mixed[: rng.randrange(20, 60)], tail, 1),
        (f"{lead}{key}{sign}{quote}", prefix + body, f"{quote}{tail}", 1),
        (f"{lead}{rng.choice(['commit', 'sha256', 'checksum', 'md5:', 'revision', 'uuid', 'build'])} ", rng.choice([hexes[:40], hexes[:32], hexes[:64], f"{hexes[:8]}-{hexes[8:12]}-{hexes[12:16]}-{hexes[16:20]}-{hexes[20:32]}"]), tail, 0),
        (f"{lead}https://{pick().lower()}.example.org/", f"{pick().lower()}/{pick().lower()}/{rng.randrange(10**6)}", f".html{tail}", 0),
        (lead, f"{pick()}{pick()}{rng.randrange(100)}", f"@{pick().lower()}{rng.randrange(9)}.example.com{tail}", 0),
        (f"{lead}{address}@", f"{pick().lower()}{pick().lower()}{rng.randrange(9)}", f".example.com{tail}", 0),
        (lead, f"/usr/lib/{pick().lower()}/{pick().lower()}{rng.randrange(20)}", f".so{tail}", 0),
        (lead, f"{pick().lower()}_{pick().lower()}_{rng.randrange(1000)}", tail, 0),
        (lead, f"{pick()}-{pick()}-{rng.randrange(10)}", tail, 0),
        (lead, f"20{rng.randrange(10, 30)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", tail, 0),
        (f"{lead}{rng.choice(['', 'order ', 'tel ', 'part '])}", str(rng.randrange(10**8, 10**15)), tail, 0),
        (f"{lead}{key}{sign}", rng.choice(["changeme", "example", "xxxxxxxx", "********", "your-password", f"<{pick()}>", pick().lower() + pick().lower()]), tail, 0),
        (f"{lead}{rng.choice(['version', 'release'])} ", f"{pick().lower()}-{rng.randrange(9)}.{rng.randrange(20)}"[:40] + "-linux-x86_64", tail, 0),
    ]


def derived_findings(docs: DataFrame) -> DataFrame:
    """(text, first, after, label): labelled findings from every document."""

    def made(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for draw, text in zip(frame["draw"], frame["text"]):
                for before, value, behind, label in made_findings((text or "").split(), str(draw)):
                    out.append((before + value + behind, len(before), len(before) + len(value), label))
            yield pd.DataFrame(out, columns=["text", "first", "after", "label"])

    drawn = docs.select(F.xxhash64("doc_id", F.lit(23)).alias("draw"), "text")
    return drawn.mapInPandas(made, "text string, first int, after int, label int")


def _few_findings(findings: DataFrame) -> DataFrame:
    """A fixed set of made findings over a few words."""
    words = ["the", "and", "some", "other", "words"]
    made = [f for i in range(40) for f in made_findings(words, str(i))]
    rows = [(a + v + b, len(a), len(a) + len(v), label) for a, v, b, label in made]
    return findings.sparkSession.createDataFrame(rows, "text string, first int, after int, label int")


def fit(findings: DataFrame, known: Dictionary | None = None) -> Scanner:
    """Train on all rows of a table of labelled findings (text, first, after, label), with the dictionary of their words (words, a
    list) where none is given."""
    if findings.limit(1).count() == 0:
        findings = _few_findings(findings)
        known = Dictionary(letter_groups(["the and some other words"] * 40))
    if known is None:
        known = Dictionary.of(findings.select(F.concat_ws(" ", "words").alias("text")))

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = feature_rows(frame["text"].to_list(), list(zip(frame["first"].tolist(), frame["after"].tolist())), known)
            out = pd.DataFrame(x, columns=[f"x{j}" for j in range(N_FEATURES)])
            yield out.assign(label=frame["label"].to_numpy(dtype=float))

    names = ", ".join(f"x{j} double" for j in range(N_FEATURES))
    # Stored, since the forest reads its rows several times.
    table = rewritten(findings.select("text", "first", "after", "label").mapInPandas(rows, f"{names}, label double"))
    return Scanner(Forest.grown(table), known)


def train(docs: DataFrame) -> Scanner:
    return fit(derived_findings(docs), Dictionary.of(docs))


def find_secrets(docs: DataFrame, scanner: Scanner, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with n_candidates, secrets (first character, character after, score) and redacted, the text with
    every secret replaced by ``MASK``; columns of these names are replaced."""

    @F.pandas_udf("n_candidates long, secrets array<struct<first:long,after:long,score:double>>, redacted string")
    def scan(texts: pd.Series) -> pd.DataFrame:
        out = []
        for at in range(0, len(texts), 500):
            some = list(texts.iloc[at : at + 500])
            for text, found in zip(some, scanner.scan(some)):
                secrets = [s for s in found if s[2] >= threshold]
                redacted = text
                for first, after, _ in reversed(secrets):
                    redacted = redacted[:first] + MASK + redacted[after:]
                out.append((len(found), [dict(zip(("first", "after", "score"), s)) for s in secrets], redacted))
        return pd.DataFrame(out, columns=["n_candidates", "secrets", "redacted"])

    out = docs.withColumn("_scan", scan("text"))
    return out.withColumns({c: F.col(f"_scan.{c}") for c in ("n_candidates", "secrets", "redacted")}).drop("_scan")


def redact(docs: DataFrame, scanner: Scanner) -> DataFrame:
    """The documents with their secrets masked; n_chars, where present, follows."""
    out = find_secrets(docs, scanner)
    hit = F.size("secrets") > 0
    changes = {"text": F.when(hit, F.col("redacted")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(hit, F.char_length("redacted").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.withColumns(changes).select(*docs.columns)
