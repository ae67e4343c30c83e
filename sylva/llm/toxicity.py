"""Toxicity by weak supervision.

Voters are words of an abuse lexicon, patterns of abusive speech, and words and word beginnings mined from learning rows by
their log odds, whatever the language; each fires or abstains on a whole text. A generative label model estimates, from how
often voters fire and fire together over all documents, each voter's rates under both labels and which voters depend on each
other beyond that; known labels of learning rows enter as observed values of the label. The model's posteriors over a
bounded sample then teach a linear classifier on the voters and hashed words, and it scores every text.

Defined cases: a null or empty text fires no voter and gets the classifier's base score; without learning labels no voter is
mined and the rates start from stated priors; labels are taken once a doc_id, 1 if any row says 1; repeated rows are scored
alike; a very long text is looked at whole; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylva.llm import common

LEXICON = (
    "abomination airhead arse asshole bastard bitch blockhead bonehead brainless brat buffoon bullshit clown cockroach coward "
    "cretin crap cunt degenerate despicable dimwit dipshit disgrace disgusting dumb dumbass dunce dweeb fatso filth filthy fool "
    "freak fuck fucker fucking garbage gross halfwit hateful hideous hypocrite idiot idiotic imbecile jackass jerk kill leech "
    "liar loser lowlife lunatic maggot miserable moron moronic muppet nasty nitwit numbskull pathetic peasant pig piss prick "
    "psycho puke rat repulsive retard revolting rubbish scoundrel scum scumbag shit shitty shut sickening simpleton slime slob "
    "sewage snake stupid sucker thug trash traitor trashy twit ugly useless vermin vile weakling weasel wimp worm worthless wretch"
).split()
INSULTS = "idiot moron loser fool scum trash clown pig stupid dumb ugly pathetic worthless disgusting".split()
HATING = "hate despise loathe".split()
ORDERS = ["go to hell", "drop dead", "get lost", "kill yourself"]
PATTERNS = {
    "second person": re.compile(rf"\b(?:you|u)(?: are|'re|r)? (?:an? |all |such |nothing but )*(?:{'|'.join(INSULTS)})"),
    "hate": re.compile(rf"\b(?:i|we) (?:{'|'.join(HATING)}) (?:you|them|those)"),
    "shut up": re.compile(r"\bshut (?:the \w+ )?up\b"),
    "go away": re.compile(rf"\b(?:{'|'.join(ORDERS)})\b"),
    "masked": re.compile(r"\b[a-z]{1,3}[*@#$]{2,}[a-z]*\b"),
}
#: What stands in every match of a pattern, one of them at least: a text without any can't match and isn't searched.
NEEDED = {"second person": INSULTS, "hate": HATING, "shut up": ["shut "], "go away": ORDERS, "masked": ["*", "@", "#", "$"]}
#: Mining: learning rows looked at a label, voters kept, letters of a word beginning, rows of label 1 a voter needs (and
#: their least share), lower bound of its log odds.
MINE_ROWS, MINED, BEGINNINGS, MINE_LEAST, MINE_SHARE, MINE_ODDS = 3_000, 256, range(4, 9), 4, 0.004, 1.8
#: A mined voter fires where what it looks for stands so often, and once in so many words at least.
TIMES, RARE = (1, 2, 3), 200
#: Bounds of the classifier's sample, its hashed word features, and the label model's starting rates.
SAMPLE, HASHED, PRIOR, FIRES, MISFIRES = 4_000, 1 << 11, 0.08, 0.3, 0.002
THRESHOLD = 0.7


class _Facts(dict):
    """word -> (hashed column, voters of the lexicon that fire on it, mined grams in it), remembered up to a bound."""

    def __init__(self, places: dict[str, int]):
        self.places = places

    def __missing__(self, word: str) -> tuple[int, int, tuple[int, ...]]:
        if len(self) >= 400_000:
            self.clear()
        found = [self.places[g] for g in _grams_of(word) if g in self.places] if self.places else []
        facts = self[word] = ((xxhash.xxh64_intdigest(word) >> 40) % HASHED, _LISTED.get(word, -1), tuple(found))
        return facts


_LISTED = {w: k for k, w in enumerate(LEXICON)}


def _grams_of(word: str) -> list[str]:
    """What may become a voter: the word itself ("=word") and its beginnings ("word")."""
    return [f"={word}", *(word[:n] for n in BEGINNINGS if n <= len(word))] if len(word) > 2 else []


class Voters:
    """All voters, by place: lexicon, mined (gram, times), patterns, two and four different words of the lexicon."""

    def __init__(self, mined: tuple[tuple[str, int], ...] = ()):
        self.mined = tuple(mined)
        self.names = (*LEXICON, *(f"{g} {times}x" for g, times in self.mined), *PATTERNS, "two", "four")
        self.n = len(self.names)
        places = {g: k for k, g in enumerate(dict.fromkeys(g for g, _ in self.mined))}
        self._facts = _Facts(places)
        self._voters: list[list[tuple[int, int]]] = [[] for _ in places]
        for k, (g, times) in enumerate(self.mined, len(LEXICON)):
            self._voters[places[g]].append((times, k))

    def __reduce__(self):
        return Voters, (self.mined,)

    def look(self, text: str | None) -> tuple[set[int], list[int]]:
        """(voters that fire, hashed columns of the text's words)."""
        low = (text or "").lower()
        words = common.WORD.findall(low)
        counts = Counter(words)
        fired, columns, times = set(), set(), {}
        for word, facts in zip(counts, map(self._facts.__getitem__, counts), strict=True):
            columns.add(facts[0])
            if facts[1] >= 0:
                fired.add(facts[1])
            for g in facts[2]:
                times[g] = times.get(g, 0) + counts[word]
        listed = len(fired)
        for g, n in times.items():
            if n * RARE >= len(words):
                fired.update(k for least, k in self._voters[g] if n >= least)
        for k, (name, pattern) in enumerate(PATTERNS.items(), self.n - len(PATTERNS) - 2):
            if any(x in low for x in NEEDED[name]) and pattern.search(low):
                fired.add(k)
        if listed >= 2:
            fired.add(self.n - 2)
        if listed >= 4:
            fired.add(self.n - 1)
        return fired, sorted(columns)

    def votes(self, text: str | None) -> np.ndarray:
        out = np.zeros(self.n, bool)
        out[list(self.look(text)[0])] = True
        return out

    def mask(self, fired: set[int]) -> bytes:
        """The voters that fire, as bits."""
        out = np.zeros(self.n, bool)
        out[list(fired)] = True
        return np.packbits(out).tobytes()

    def unmask(self, masks: list[bytes]) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(masks), np.uint8).reshape(len(masks), -1), axis=1, count=self.n) if masks else np.zeros((0, self.n), np.uint8)


def candidates(text: str | None) -> set[tuple[str, int]]:
    """The mined voters that would fire on a text, were they chosen."""
    words = common.WORD.findall((text or "").lower())
    times: dict[str, int] = {}
    for word, n in Counter(words).items():
        for g in _grams_of(word):
            times[g] = times.get(g, 0) + n
    return {(g, least) for g, n in times.items() if n * RARE >= len(words) for least in TIMES if n >= least}


def mine(spark: SparkSession, docs: DataFrame, labels: DataFrame, rows: int = MINE_ROWS, most: int = MINED) -> Voters:
    """Voters with the words and beginnings that speak most surely for label 1 in ``rows`` learning rows of each label.

    They are ranked by the lower bound of their log odds times the root of how many rows of label 1 they fire on; one that
    begins another, or continues it, and fires on nearly the same number of rows is left out.
    """
    chosen = None
    for y in (1, 0):
        part = labels.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(21), "doc_id"), "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ys, texts in common.column_lists(batches):
            for at in range(0, len(ys), 64):
                counts: dict[tuple[str, int], list[int]] = {("", 0): [0, 0]}  # which counts the rows
                for y, text in zip(ys[at : at + 64], texts[at : at + 64], strict=True):
                    for g in (("", 0), *candidates(text)):
                        counts.setdefault(g, [0, 0])[y] += 1
                yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in counts]), pa.array([t for _, t in counts], pa.int32()), pa.array([c[1] for c in counts.values()], pa.int64()), pa.array([c[0] for c in counts.values()], pa.int64())], names=["gram", "times", "n1", "n0"])

    looked = docs.join(F.broadcast(chosen), "doc_id").select(F.col("y").cast("int").alias("y"), "text")
    counted = common.stage(spark, looked.mapInArrow(run, "gram string, times int, n1 long, n0 long").groupBy("gram", "times").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0")).filter(f"n1 >= {MINE_LEAST} OR gram = ''"), "grams")
    total = counted.filter("gram = ''").first()
    if total is None or not total.n1 or not total.n0:
        common.remove(spark, counted)
        return Voters()
    odds = F.log((F.col("n1") + 0.5) / (total.n1 + 1)) - F.log((F.col("n0") + 0.5) / (total.n0 + 1)) - F.sqrt(1 / (F.col("n1") + 0.5) + 1 / (F.col("n0") + 0.5))
    sure = counted.filter((F.col("gram") != "") & (F.col("n1") >= MINE_SHARE * total.n1)).withColumn("odds", odds).filter(F.col("odds") >= MINE_ODDS)
    found = sure.orderBy(F.desc(F.col("odds") * F.sqrt("n1")), "gram", "times").limit(16 * most).collect()
    common.remove(spark, counted)
    kept: dict[tuple[str, int], int] = {}
    for r in found:
        plain = r.gram.lstrip("=")
        near = [n for (g, _), n in kept.items() if plain.startswith(g.lstrip("=")) or g.lstrip("=").startswith(plain)]
        if len(kept) < most and plain not in _LISTED and all(min(n, r.n1) <= 0.7 * max(n, r.n1) for n in near):
            kept[r.gram, r.times] = r.n1
    return Voters(tuple(kept))


@dataclass
class LabelModel:
    prior: float
    fires: np.ndarray  # P(voter fires | toxic)
    misfires: np.ndarray  # P(voter fires | not toxic)
    dependence: np.ndarray  # correlation of voters beyond what the label explains, where it is strong, else 0
    weight: np.ndarray  # what that leaves of a voter's evidence on average

    @property
    def dependent(self) -> list[tuple[int, int]]:
        return [(int(x), int(y)) for x, y in zip(*np.nonzero(np.triu(self.dependence)), strict=True)]

    def evidence(self) -> np.ndarray:
        """Log odds that each voter adds when it fires, on average."""
        return self.weight * np.log(self.fires / self.misfires)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(toxic | votes); a voter that abstains says nothing, one that fires says less beside those it depends on."""
        v = v.astype(np.float64)
        each = v * np.log(self.fires / self.misfires) / (1 + v @ self.dependence)
        z = np.log(self.prior / (1 - self.prior)) + each.sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


Moments = dict[int, tuple[float, np.ndarray, np.ndarray]]


def label_model(moments: Moments, n_voters: int, rounds: int = 1_000) -> LabelModel:
    """From counts, firing counts and joint firing counts of rows known as 0, known as 1, and unknown (-1).

    The rates minimise the squared misfit of single and joint firing rates of all rows to those of two labels under which
    voters are independent; known rows start and anchor them. Two voters for one label fire together more often than by
    chance; pairs that don't (such as words of two languages) depend on each other through something else and are left out
    of that fit. Pairs whose joint rate stays above by more than chance are dependent, which takes from their evidence.
    """
    v = n_voters
    none = (0.0, np.zeros(v), np.zeros((v, v)))
    n0, s0, c0 = moments.get(0, none)
    n1, s1, c1 = moments.get(1, none)
    n, s, c = (sum(m[k] for m in moments.values()) if moments else z for k, z in enumerate(none))
    prior = (n1 + 50 * PRIOR) / (n0 + n1 + 50)
    # a voter never seen with a known label begins at its stated rates, and one seen with some at theirs
    anchor_a, anchor_b = (s1 + 10 * np.where(s1 + s0 > 0, np.minimum(FIRES, (s1 + 1) / (n1 + 1)), FIRES)) / (n1 + 10), (s0 + 500 * MISFIRES) / (n0 + 500)
    a, b = anchor_a.copy(), anchor_b.copy()
    if n:
        single, joint = s / n, c / n
        off = ~np.eye(v, dtype=bool)
        off[-2:] = off[:, -2:] = False  # the counting voters repeat the lexicon's
        fitted = off & (joint >= np.outer(single, single))
        # how far known labels hold the rates; they may be wrong themselves, so the joint rates weigh more
        hold = 0.02 * (n0 + n1 + 50) / (n + 50)
        for _ in range(rounds):
            miss = np.where(fitted, prior * np.outer(a, a) + (1 - prior) * np.outer(b, b) - joint, 0)
            one = prior * a + (1 - prior) * b - single
            a = np.clip(a - 2 * (prior * (miss @ a + one) + hold * prior * (a - anchor_a)), 1e-4, 0.999)
            b = np.clip(b - 0.1 * ((1 - prior) * (miss @ b + one) + hold * (b - anchor_b)), 1e-5, 0.999)
            two, gap = np.where(fitted, np.outer(a, a) - np.outer(b, b), 0), a - b
            best = ((two * (joint - np.outer(b, b))).sum() + (gap * (single - b)).sum()) / max((two**2).sum() + (gap**2).sum(), 1e-9)
            prior = float(np.clip(0.9 * prior + 0.1 * best, 0.005, 0.5))
        a, b = np.maximum(a, 1e-3), np.maximum(b, 1e-4)
        expected = prior * np.outer(a, a) + (1 - prior) * np.outer(b, b)
        spread = np.sqrt(np.maximum(np.outer(single * (1 - single), single * (1 - single)), 1e-12))
        correlation = np.where(off, (joint - expected) / spread, 0)
        correlation[~np.isfinite(correlation) | (np.minimum.outer(s, s) < 5)] = 0
    else:
        correlation, joint, single = np.zeros((v, v)), np.zeros((v, v)), np.ones(v)
    dependence = np.where(correlation > 0.15, correlation, 0)
    beside = (dependence * joint).sum(1) / np.maximum(single, 1e-12)
    return LabelModel(float(np.clip(prior, 1e-3, 0.999)), a, b, dependence, 1 / (1 + beside))


def moments_of(looks: DataFrame, labels: DataFrame, voters: Voters) -> Moments:
    """Firing counts over all of ``looks`` by known label; ``labels``: doc_id, y. Partial sums of fixed size are added up."""
    v = voters.n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for ids, masks in common.column_lists(batches):
            bits, known = voters.unmask(masks).astype(np.float32), np.array(ids)
            for y in np.unique(known).tolist():
                on = bits[known == y]
                total = np.concatenate([[len(on)], on.sum(0), (on.T @ on).ravel()]).astype(np.float64)
                sums[y] = sums.get(y, 0) + total
        for y, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), y, np.int32)), pa.array(some.astype(np.int32)), pa.array(total[some])], names=["y", "at", "n"])

    marked = looks.select("doc_id", "mask").join(labels, "doc_id", "left").select(F.coalesce("y", F.lit(-1)).alias("y"), "mask")
    out: dict[int, np.ndarray] = {}
    for r in marked.mapInArrow(run, "y int, at int, n double").groupBy("y", "at").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r.y, np.zeros(1 + v + v**2))[r["at"]] = r.n
    return {y: (float(t[0]), t[1 : v + 1], t[v + 1 :].reshape(v, -1)) for y, t in out.items()}


def looked_at(spark: SparkSession, docs: DataFrame, voters: Voters) -> DataFrame:
    """doc_id, draw (a hash of the text), mask (voters that fire, as bits), cols (hashed columns, packed) of every row, staged.

    Rates, sample and scores are read from it, so that a text is looked at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, draws, texts in common.column_lists(batches):
            made = [voters.look(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(draws, pa.int64()), pa.array([voters.mask(f) for f, _ in made], pa.binary()), pa.array([packed(c) for _, c in made], pa.binary())], names=["doc_id", "draw", "mask", "cols"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(5), "text").alias("draw"), F.col("text").cast("string").alias("text"))
    return common.stage(spark, rows.mapInArrow(run, "doc_id long, draw long, mask binary, cols binary"), "looks")


def packed(columns: list[int]) -> bytes:
    """Hashed columns in ascending order as numbers of two bytes, or all columns as bits where that is no longer."""
    if 2 * len(columns) < HASHED // 8:
        return np.array(columns, "<u2").tobytes()
    bits = np.zeros(HASHED, bool)
    bits[columns] = True
    return np.packbits(bits).tobytes()


def unpacked(columns: bytes) -> np.ndarray:
    if len(columns) < HASHED // 8:
        return np.frombuffer(columns, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(columns, np.uint8)))


@dataclass
class Classifier:
    voters: Voters
    weights: np.ndarray
    hashed: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        looks = [self.voters.look(t) for t in texts]
        return self.scores_of([self.voters.mask(f) for f, _ in looks], [packed(c) for _, c in looks])

    def scores_of(self, masks: list[bytes], packs: list[bytes]) -> np.ndarray:
        """Of texts looked at before."""
        z = np.full(len(masks), self.bias)
        for k, (votes, pack) in enumerate(zip(self.voters.unmask(masks), packs, strict=True)):
            fired, columns = np.flatnonzero(votes), unpacked(pack)
            if len(fired):
                z[k] += self.weights[fired].sum()
            if len(columns):
                z[k] += self.hashed[columns].sum() / len(columns) ** 0.5
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(voters: Voters, votes: np.ndarray, hashed: list[np.ndarray], target: np.ndarray, model: LabelModel, rounds: int = 200) -> Classifier:
    """Logistic regression on soft labels, begun at the label model's evidence; hashed words are held down."""
    n = len(target)
    wv = model.evidence().astype(np.float32)
    wh, bias = np.zeros(HASHED, np.float32), float(np.log(model.prior / (1 - model.prior)))
    if not n:
        return Classifier(voters, wv, wh, bias)
    x = np.zeros((n, HASHED), np.float32)
    for k, c in enumerate(hashed):
        x[k, c] = 1 / np.sqrt(max(len(c), 1))
    v = votes.astype(np.float32)
    gv, gh, gb = np.full(voters.n, 1e-6, np.float32), np.full(HASHED, 1e-6, np.float32), 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(v @ wv + x @ wh + bias, -30, 30)))
        e = ((p - target) / n).astype(np.float32)
        dv, dh, db = v.T @ e, x.T @ e + np.float32(3e-3) * wh, float(e.sum())
        gv, gh, gb = gv + dv**2, gh + dh**2, gb + db**2
        wv, wh, bias = wv - np.float32(0.1) * dv / np.sqrt(gv), wh - np.float32(0.01) * dh / np.sqrt(gh), bias - 0.1 * db / gb**0.5
    return Classifier(voters, wv, wh, bias)


def learn(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[LabelModel, Classifier]:
    """Label model over all ``docs``; classifier on ``sample`` of them, half with a firing voter where there are enough."""
    voters = mine(spark, docs, labels)
    looks = looked_at(spark, docs, voters)
    learned = learn_from(spark, looks, labels, voters, sample)
    common.remove(spark, looks)
    return learned


def learn_from(spark: SparkSession, looks: DataFrame, labels: DataFrame, voters: Voters, sample: int = SAMPLE) -> tuple[LabelModel, Classifier]:
    model = label_model(moments_of(looks, labels, voters), voters.n)
    chance = min(1.0, 4 * sample / max(looks.count(), 1))
    drawn = looks.filter(F.pmod("draw", F.lit(1 << 30)) / float(1 << 30) < chance).select("mask", "cols")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for masks, packs in common.column_lists(batches):
            yield pa.RecordBatch.from_arrays([pa.array([any(m) for m in masks]), pa.array(masks, pa.binary()), pa.array([unpacked(c).astype("<u2").tobytes() for c in packs], pa.binary())], names=["fires", "mask", "cols"])

    made = common.stage(spark, drawn.mapInArrow(run, "fires boolean, mask binary, cols binary"), "drawn")
    rows = [r for fires in (True, False) for r in made.filter(F.col("fires") == fires).orderBy(F.xxhash64("cols", "mask")).limit(sample // 2).collect()]
    common.remove(spark, made)
    v = voters.unmask([bytes(r.mask) for r in rows])
    return model, train(voters, v, [np.frombuffer(r.cols, "<u2").astype(np.int64) for r in rows], model.posterior(v) if len(rows) else np.zeros(0), model)


def known(labels: DataFrame, column: str) -> DataFrame:
    """doc_id, y of the learning rows: one a document, bounded by nothing but the labels there are."""
    return labels.filter((common.remainder("doc_id", 3) != 1) & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("y"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = known(common.table(spark, sf_dir, "labels"), "toxic")
    voters = mine(spark, docs, labels)
    looks = looked_at(spark, docs, voters)
    _, classifier = learn_from(spark, looks, labels, voters)
    return _scored(spark, looks.select("doc_id", "mask", "cols"), classifier.scores_of, THRESHOLD)


def scored(spark: SparkSession, docs: DataFrame, scores, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; ``scores``: list of texts -> array of numbers."""
    return _scored(spark, docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), scores, threshold)


def _scored(spark: SparkSession, rows: DataFrame, scores, threshold: float) -> DataFrame:
    """``scores`` takes the lists of all columns after doc_id."""
    shared = spark.sparkContext.broadcast(scores)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = shared.value
        for ids, *columns in common.column_lists(batches):
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(of(*columns), pa.float64())], names=["doc_id", "score"])

    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (common.remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
