"""Toxicity by a weighted finite-state pattern grammar.

Five lexical transducers read the letters of a word and write a weighted tag: insult (words and
word stems, each with a weight), threat, target, negation and reported speech (closed-class
words of four languages). Their union is one trie whose states are prefixes. A word that none
accepts has the tag "other".

Three transducers over tags rewrite a clause's tags, one for one:

* negation: for ``SCOPE`` words after a negation, unless a target comes between, hits (insults
  and threats) are marked as negated;
* reported speech: for ``SCOPE`` words after a word of saying, hits are marked as reported;
* target: hits in a clause with a target, before or after them, are marked as aimed. It reads
  from left to right and guesses that a target will follow; a path with a wrong guess doesn't end
  in a final state. A threat that isn't aimed becomes "other".

Their composition is the clause grammar ``[reported] [target] [negation] (insult | threat)+
[target]``, with other words anywhere between, and is made by the usual product of
transducers. A clause's reading is its path of greatest weight from the start to a final state;
a path weighs what its arcs weigh in sum, insults with their lexicon's weight and ``AIMED`` for
each hit with a target. A document's features are sums over the hits of its clauses' readings,
never over words outside a match, and a logistic model turns them into a score.

The insult lexicon and the model's weights are learned from labelled rows: words and
stems are candidates, weighed by the log odds of toxic against other documents.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import materialize

#: At most so many labelled rows are used to learn from, the first by a hash of their id.
SAMPLE_ROWS = 12_000
#: Lengths of stems that are tried as prefixes, and the least number of toxic documents with one.
STEM_LENGTHS, LEAST_DOCS, LEXICON = (4, 5, 6, 7), 8, 400
#: Least share of the toxic documents with an entry, so that a few near copies don't make one; so many different
#: texts are enough for any sample, so that a language with few toxic documents has entries too.
LEAST_SHARE, ENOUGH_DOCS = 0.02, 30
#: Words that a worker keeps the tags of.
KEPT_WORDS = 100_000
#: Least log odds of a lexicon entry.
LEAST_WEIGHT = 1.5

WORD = re.compile(r"[^\W\d_]+")
CLAUSE = re.compile(r"[.!?;:\n|]+")

# Closed-class words of English, German, French and Spanish.
THREAT = "kill hurt destroy beat shoot burn töte schlage zerstöre tuer frapper détruire matar golpear destruir"
TARGET = "you your he she they him her them du dich dein ihr euch sie tu toi vous ton votre tú ti usted ustedes"
NEGATION = "not no never isn't don't nicht kein keine nie niemals ne pas jamais nunca jamás ni"
REPORTED = "said says wrote called reported quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó"
THREATS, TARGETS, NEGATIONS, REPORTS = (frozenset(x.split()) for x in (THREAT, TARGET, NEGATION, REPORTED))

#: Words before a hit in which negation or reported speech governs it, and the weight of a hit with a target.
SCOPE, AIMED = 4, 0.5

OTHER, INSULT, THREAT_TAG, TARGET_TAG, NEGATION_TAG, REPORT_TAG = "o", "I", "T", "G", "N", "R"
#: Marks that transducers put behind a hit's tag.
NEGATED, QUOTED, AT_TARGET = "-", '"', "@"


@dataclass
class Transducer:
    """Reads a tag and writes a tag on each arc. Arcs: state -> tag -> [(written tag, weight, next state)]."""

    start: object
    finals: set
    arcs: dict

    def then(self, other: Transducer) -> Transducer:
        """The composition: what this one writes is what the other reads. Weights add up."""
        start = (self.start, other.start)
        made, arcs, finals = [start], {}, set()
        for state in made:  # grows
            p, q = state
            if p in self.finals and q in other.finals:
                finals.add(state)
            arcs[state] = own = {}
            for tag, steps in self.arcs[p].items():
                for mid, w, p2 in steps:
                    for out, v, q2 in other.arcs[q].get(mid, ()):
                        own.setdefault(tag, []).append((out, w + v, (p2, q2)))
                        if (p2, q2) not in arcs and (p2, q2) not in made:
                            made.append((p2, q2))
        return Transducer(start, finals, arcs)

    def read(self, tags: list[list[tuple[str, float]]]) -> list[str] | None:
        """The tags written on the path of greatest weight; each place has one or more weighted tags to read.

        Of paths with equal weights, the first by the order of arcs. None if no path ends in a final state.
        """
        paths = {self.start: (0.0, None)}  # state -> weight, (written tag, the path before)
        for place in tags:
            new: dict = {}
            for state, (weight, path) in paths.items():
                arcs = self.arcs[state]
                for tag, own in place:
                    for out, w, to in arcs.get(tag, ()):
                        total = weight + own + w
                        if to not in new or total > new[to][0]:
                            new[to] = (total, (out, path))
            paths = new
        ends = [paths[s] for s in paths if s in self.finals]
        if not ends:
            return None
        path, out = max(ends, key=lambda x: x[0])[1], []
        while path is not None:
            out.append(path[0])
            path = path[1]
        return out[::-1]


def _is_hit(tag: str) -> bool:
    return tag[0] in (INSULT, THREAT_TAG)


def scope(opens: str, mark: str, tags: list[str], closes: str = "") -> Transducer:
    """Marks the hits of ``SCOPE`` words after a tag that opens. States: words left in the scope."""
    arcs: dict = {}
    for left in range(SCOPE + 1):
        arcs[left] = {}
        for tag in tags:
            out = tag + mark if left and _is_hit(tag) else tag
            to = SCOPE if tag == opens else 0 if tag == closes else max(left - 1, 0)
            arcs[left][tag] = [(out, 0.0, to)]
    return Transducer(0, set(arcs), arcs)


def at_target(tags: list[str]) -> Transducer:
    """Marks the hits of clauses with a target. States: no target so far, one is promised, one was seen."""
    arcs: dict = {state: {} for state in ("none", "promised", "seen")}
    for tag in tags:
        if not _is_hit(tag):
            seen = tag == TARGET_TAG
            for state in arcs:
                arcs[state][tag] = [(tag, 0.0, "seen" if seen else state)]
        else:
            aimed = (tag + AT_TARGET, AIMED)
            alone = (OTHER if tag[0] == THREAT_TAG else tag, 0.0)
            arcs["none"][tag] = [(*alone, "none"), (*aimed, "promised")]
            arcs["promised"][tag], arcs["seen"][tag] = [(*aimed, "promised")], [(*aimed, "seen")]
    return Transducer("none", {"none", "seen"}, arcs)


def clause_grammar() -> Transducer:
    plain = [OTHER, INSULT, THREAT_TAG, TARGET_TAG, NEGATION_TAG, REPORT_TAG]
    negated = plain + [t + NEGATED for t in plain if _is_hit(t)]
    quoted = negated + [t + QUOTED for t in negated if _is_hit(t)]
    return (
        scope(NEGATION_TAG, NEGATED, plain, closes=TARGET_TAG).then(scope(REPORT_TAG, QUOTED, negated)).then(at_target(quoted))
    )


@dataclass
class Lexicon:
    """The union of the lexical transducers: reads letters, accepts at a state with weighted tags.

    A state that ends a whole word only is told apart from one that ends a stem.
    """

    root: dict = field(default_factory=dict)

    def add(self, entry: str, kind: str, tag: str, weight: float) -> None:
        """``kind`` is "word" or "stem"."""
        state = self.root
        for letter in entry:
            state = state.setdefault(letter, {})
        state.setdefault(kind, {})[tag] = weight

    @classmethod
    def of(cls, words: dict[str, float], stems: dict[str, float]) -> Lexicon:
        out = cls()
        for entry, weight in words.items():
            out.add(entry, "word", INSULT, weight)
        for entry, weight in stems.items():
            out.add(entry, "stem", INSULT, weight)
        closed = ((THREATS, THREAT_TAG), (TARGETS, TARGET_TAG), (NEGATIONS, NEGATION_TAG), (REPORTS, REPORT_TAG))
        for entries, tag in closed:
            for entry in sorted(entries):
                out.add(entry, "word", tag, 0.0)
        return out

    def read(self, word: str) -> list[tuple[str, float]]:
        """The word's tags, each with its greatest weight; "other" where there is none."""
        state, found = self.root, {}
        for letter in word:
            state = state.get(letter)
            if state is None:
                break
            for tag, w in state.get("stem", {}).items():
                found[tag] = max(w, found.get(tag, 0.0))
        if state is not None:
            for tag, w in state.get("word", {}).items():
                found[tag] = max(w, found.get(tag, 0.0))
        # Closed-class words keep their part; of an insult and another part, the insult's weight decides.
        return list(found.items()) or [(OTHER, 0.0)]


#: Features of a document, all sums over matched clauses.
FEATURES = ("insults", "weight", "density", "clauses", "repeated", "aimed", "negated", "reported", "threats", "variety")


class Grammar:
    """Lexicon and clause grammar over a whole text."""

    def __init__(self, words: dict[str, float], stems: dict[str, float]):
        self.lexicon, self.grammar = Lexicon.of(words, stems), clause_grammar()
        #: Tags of words that were met.
        self.tags: dict[str, list[tuple[str, float]]] = {}
        stem = "|".join(sorted(map(re.escape, stems), key=len, reverse=True))
        word = "|".join(sorted(map(re.escape, words), key=len, reverse=True))
        threat = "|".join(sorted(map(re.escape, THREATS), key=len, reverse=True))
        parts = [x for x in (f"(?:{stem})[^\\W\\d_]*" if stem else "", f"(?:{word})" if word else "", f"(?:{threat})") if x]
        # A first pass finds where any insult or threat stands; only clauses there can have a hit.
        self.first = re.compile(r"(?<![^\W\d_])(?:" + "|".join(parts) + r")(?![^\W\d_])")

    def read_word(self, word: str) -> list[tuple[str, float]]:
        found = self.tags.get(word)
        if found is None:
            found = self.lexicon.read(word)
            if len(self.tags) < KEPT_WORDS:
                self.tags[word] = found
        return found

    def clause(self, words: list[str]) -> tuple[float, int, int, int, int, int]:
        """The best reading of a clause: weight, insults, aimed, negated, reported, threats.

        The first five are of its insults; threats are those with a target that aren't negated.
        """
        tags = [self.read_word(w) for w in words]
        total, insults, threats, aimed, negated, reported = 0.0, 0, 0, 0, 0, 0
        for own, out in zip(tags, self.grammar.read(tags), strict=True):
            if out[0] == INSULT:
                total += dict(own)[INSULT]
                insults += 1
                aimed += AT_TARGET in out
                negated += NEGATED in out
                reported += QUOTED in out
            elif out[0] == THREAT_TAG:
                threats += NEGATED not in out
        return total, insults, aimed, negated, reported, threats

    def features(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(FEATURES))
        if not text:
            return out
        low = text.lower()
        found = [m.span() for m in self.first.finditer(low)]
        if not found:
            return out
        sums = np.zeros(6)
        kinds = {w for w in {low[a:b] for a, b in found} if INSULT in dict(self.read_word(w))}
        clauses, at = 0, 0
        for a, _ in found:
            if a < at:
                continue  # in a clause that is parsed already
            begin = at
            for m in CLAUSE.finditer(low, at, a):
                begin = m.end()
            stop = CLAUSE.search(low, a)
            at = stop.start() if stop else len(low)
            own = self.clause(WORD.findall(low, begin, at))
            sums += own
            # A threat without a target matches nothing.
            clauses += own[5] > 0 or own[1] > 0
        weight, insults, aimed, negated, reported, threats = sums
        length = max(len(low) / 6.0, 1.0)
        out[:] = (
            math.log1p(insults),
            math.log1p(weight),
            min(insults / length * 100, 10),
            math.log1p(clauses),
            insults >= 2,
            math.log1p(aimed),
            math.log1p(negated),
            math.log1p(reported),
            math.log1p(threats),
            math.log1p(len(kinds)),
        )
        return out


@dataclass
class Model:
    words: dict[str, float]
    stems: dict[str, float]
    weights: list[float]
    bias: float

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ np.array(self.weights) + self.bias, -30, 30)))


def in_training(doc_id: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) != 0


def _candidates(batches):
    """(entry, is stem, label) counts of documents, summed over a batch."""
    import pyarrow as pa

    counts: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            words = set(WORD.findall((text.as_py() or "").lower()))
            own = {(w, False) for w in words if len(w) >= 3}
            own |= {(w[:n], True) for n in STEM_LENGTHS for w in words if len(w) > n}
            counts.update((e, s, label) for e, s in own)
    for a in range(0, len(items := list(counts.items())), 50_000):
        own = items[a : a + 50_000]
        yield pa.RecordBatch.from_pydict(
            {
                "entry": pa.array([k[0] for k, _ in own], pa.string()),
                "stem": pa.array([k[1] for k, _ in own], pa.bool_()),
                "toxic": pa.array([k[2] for k, _ in own], pa.int32()),
                "n": pa.array([v for _, v in own], pa.int64()),
            }
        )


def lexicon(counts: list[tuple[str, bool, int, int]], toxic: int, others: int) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their weights, from (entry, stem, toxic documents, other documents).

    A stem is dropped if a shorter one is as telling, and a word if a stem covers it.
    """
    weight = {}
    for entry, stem, a, b in counts:
        w = math.log((a + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (others + 1))
        # One standard error less, so that rare entries need clearer odds.
        w -= math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        if w >= LEAST_WEIGHT:
            weight[entry, stem] = (w, a)
    stems: dict[str, float] = {}
    for (entry, stem), (w, a) in sorted(weight.items(), key=lambda x: (len(x[0][0]), x[0][0])):
        shorter = [weight[entry[:n], True] for n in STEM_LENGTHS if n < len(entry) and entry[:n] in stems]
        if stem and not any(w <= sw + 0.7 for sw, _ in shorter):
            stems[entry] = w
    words: dict[str, float] = {}
    for (entry, stem), (w, a) in weight.items():
        cover = [stems[entry[:n]] for n in STEM_LENGTHS if entry[:n] in stems]
        if not stem and not any(w <= c + 0.7 for c in cover):
            words[entry] = w
    # A stem that one word makes up is that word.
    for s in list(stems):
        if any(w.startswith(s) and weight[w, False][1] >= 0.95 * weight[s, True][1] for w in words):
            del stems[s]
    keep = sorted([(w, e, False) for e, w in words.items()] + [(w, e, True) for e, w in stems.items()], reverse=True)[:LEXICON]
    return {e: w for w, e, s in keep if not s}, {e: w for w, e, s in keep if s}


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1.0) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn lexicon and weights from at most ``sample_rows`` labelled rows.

    Rows for held-out tests (crc32 of the id, as text, divisible by 5) are never used, nor
    are rows with a null label or id. Of equal texts with equal labels, one counts. Without both
    labels in the sample, the model scores every text at the labels' mean, or at 0.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & in_training())
    picked = rows.select("doc_id", F.col("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
    picked = picked.limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    texts = materialize(texts.select("text", "toxic").dropDuplicates(), "labelled")
    ns = {r["toxic"]: r["n"] for r in texts.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, others = ns.get(1, 0), sum(n for k, n in ns.items() if k != 1)
    if not toxic or not others:
        rate = toxic / (toxic + others) if toxic + others else 0.0
        bias = math.log(rate / (1 - rate)) if 0 < rate < 1 else (30.0 if rate else -30.0)
        return Model({}, {}, [0.0] * len(FEATURES), bias)
    counted = texts.mapInArrow(_candidates, "entry string, stem boolean, toxic int, n long").groupBy("entry", "stem").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("toxic") != 1, F.col("n")).otherwise(0)).alias("b"),
    )
    least = max(3, min(LEAST_DOCS, toxic // 6), min(math.ceil(LEAST_SHARE * toxic), ENOUGH_DOCS))
    odds = F.log((F.col("a") + 0.5) / (toxic + 1)) - F.log((F.col("b") + 0.5) / (others + 1))
    telling = counted.where((F.col("a") >= least) & (odds > LEAST_WEIGHT)).orderBy(odds.desc(), "entry", "stem").limit(20 * LEXICON)
    words, stems = lexicon([(r["entry"], r["stem"], r["a"], r["b"]) for r in telling.collect()], toxic, others)
    sample = texts.mapInArrow(_features(words, stems), "features array<double>, toxic int").toArrow()
    x = np.array(sample["features"].to_pylist()).reshape(-1, len(FEATURES))
    y = (sample["toxic"].to_numpy() == 1).astype(float)
    weights, bias = logistic(x, y)
    return Model(words, stems, weights.tolist(), bias)


def _features(words, stems):
    def run(batches):
        import pyarrow as pa

        grammar = Grammar(words, stems)
        for batch in batches:
            out = [grammar.features(t.as_py()).tolist() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.list_(pa.float64())), batch.column("toxic")], ["features", "toxic"]
            )

    return run


def _score(model: Model):
    def run(batches):
        import pyarrow as pa

        grammar = Grammar(model.words, model.stems)
        for batch in batches:
            x = np.array([grammar.features(t.as_py()) for t in batch.column("text")]).reshape(-1, len(FEATURES))
            s = pa.array(np.round(model.score(x), 6))
            yield pa.RecordBatch.from_arrays([*batch.columns, s], [*batch.schema.names, "score"])

    return run


def with_score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column score from 0 to 1. One scan; a column named score is replaced.

    Null and empty texts have no match and get the score of a text without any.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    own = docs.drop("score")
    return own.mapInArrow(_score(model), StructType([*own.schema.fields, StructField("score", DoubleType())]))


def scores(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    A null doc_id stays null and isn't held out. Repeated rows are scored each and alike, other
    columns are left out, texts can have any length, and an empty table gives no rows.
    """
    model = train(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return with_score(rows, model).select(
        "doc_id",
        F.coalesce(~in_training(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose score is under 0.5, with their columns as they were."""
    own = with_score(docs.withColumnRenamed("score", "__score"), train(docs, labels, sample_rows))
    return own.where(F.col("score") < 0.5).drop("score").withColumnRenamed("__score", "score")
