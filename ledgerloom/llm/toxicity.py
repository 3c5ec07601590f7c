"""Toxicity by a weighted finite-state pattern grammar.

A lexical transducer maps each word to a symbol (insult, threat verb, target, negation, reporting verb, other) and
clause ends to one of their own.  Five transducers with states and weighted arcs are composed behind it, each reading
what the one before writes:

* threat: a threat verb that reaches a target within a few words becomes a matched threat;
* insult: an insult is isolated unless another one (or a threat) came a few clauses before it;
* target: it guesses at a clause's begin whether a target comes; on the aimed path every insult matches and weighs
  more, and the path dies at the clause's end without a target; on the other only insults that aren't isolated match;
* negation: a negation shortly before lowers what matches;
* reported speech: a reporting verb before, in the clause, lowers what matches.

The composed machine's best path through a clause scores it.  A word that no pattern matches scores nothing, however
strong it is.  A text's score adds up, for each insult, the best clause that it matches in.

The grammar's own insults are English; others (words and word beginnings, in any language) and all weights are learned
from labelled documents, by how often they occur in toxic and in clean ones.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import Scratch, ship_package, worker_state
from ledgerloom.llm.labels import crc_bucket, training_sample

# The words of the grammar.
INSULTS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "imbecile", "vermin", "filth", "bastard")
THREATS = ("kill", "hurt", "destroy", "beat", "shoot", "stab", "burn", "smash", "hang")
TARGETS = ("you", "your", "yours", "u", "them", "they", "him", "her", "she", "he", "people", "everyone", "vous", "toi", "du", "ihr", "usted", "tu")
NEGATIONS = ("not", "never", "no", "isn't", "aren't", "wasn't", "don't", "nobody", "ne", "nicht", "kein", "nunca")
REPORTS = ("said", "says", "wrote", "called", "quoted", "reported", "claimed", "according", "quote", "allegedly")

#: Weight of a threat that reaches its target, and what context makes of an insult's weight.
THREAT, TARGETED, NEGATED, REPORTED = 0.8, 1.1, 0.5, 0.6
#: Words over which a negation lasts, words within which a threat verb must reach its target, and clauses within which
#: another insult must follow for both not to be isolated.
NEGATION_SPAN, THREAT_SPAN, PILE_SPAN = 3, 4, 10
#: Lengths of word beginnings that are learned; toxic documents and occurrences there that one must have; how many
#: occurrences a document counts for at most, so that one that repeats itself says little; the least share of them that
#: toxic documents have (as if both kinds were equally many); and occurrences taken off that.
STEMS, SUPPORT, OCCURRENCES, A_TEXT, LEAST, SHRINK = (4, 5, 6, 7, 8), 3, 5, 4, 0.85, 1.0
#: A weight is the third power of that share, so that words that clean documents hold too count little; what clauses
#: add up to is put to the power at which 0.7 becomes 0.3, the usual threshold.
SHARE_POWER, SCORE_POWER = 3, math.log(0.3) / math.log(0.7)
#: Labelled rows to learn from, and learned entries, at most; words that a worker remembers, and the longest of them.
TRAINING_ROWS, ENTRIES, WORDS, WORD_LENGTH = 20_000, 20_000, 60_000, 64
#: Occurrences of the grammar's own insults before any label is seen, and their share.
OWN_SEEN, OWN = 4.0, 0.97

WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[.!?;:\n]")
ENDS = frozenset(".!?;:\n")


class Transducer:
    """Start states, and arcs (state, symbol) -> ((next state, symbol written, gain), ...); a missing arc is a dead end."""

    def __init__(self, start: tuple, arcs: dict):
        self.start, self.arcs = start, arcs

    def states(self) -> set:
        return {s for s, _ in self.arcs} | set(self.start)


def compose(a: Transducer, b: Transducer) -> Transducer:
    """The transducer that writes what ``b`` makes of what ``a`` writes; gains multiply.  States are numbered."""
    inputs = sorted({x for _, x in a.arcs})
    number = {s: k for k, s in enumerate((p, q) for p in a.start for q in b.start)}
    start, todo, arcs = tuple(number.values()), list(number), {}
    while todo:
        p, q = state = todo.pop()
        for x in inputs:
            found = []
            for p2, y, g in a.arcs.get((p, x), ()):
                for q2, z, h in b.arcs.get((q, y), ()):
                    if (p2, q2) not in number:
                        number[p2, q2] = len(number)
                        todo.append((p2, q2))
                    found.append((number[p2, q2], z, g * h))
            if found:
                arcs[number[state], x] = tuple(found)
    return Transducer(start, arcs)


def threat() -> Transducer:
    """States: words left for a threat verb to reach a target."""
    arcs = {}
    for left in range(THREAT_SPAN + 1):
        arcs |= {(left, x): ((max(left - 1, 0), x, 1.0),) for x in "INRo"}
        arcs |= {(left, "H"): ((THREAT_SPAN, "o", 1.0),), (left, "T"): ((0, "X" if left else "T", 1.0),), (left, "E"): ((0, "E", 1.0),)}
    return Transducer((0,), arcs)


def insult() -> Transducer:
    """States: clauses left in which one more insult makes a pattern."""
    arcs = {}
    for left in range(PILE_SPAN + 1):
        arcs |= {(left, x): ((left, x, 1.0),) for x in "TNRo"}
        arcs |= {(left, "I"): ((PILE_SPAN, "I" if left else "i", 1.0),), (left, "X"): ((PILE_SPAN, "X", 1.0),), (left, "E"): ((max(left - 1, 0), "E", 1.0),)}
    return Transducer((0,), arcs)


def target() -> Transducer:
    """States: free (no target is asked for), aimed (one must come), met (it came)."""
    arcs = {(s, x): ((s, x, 1.0),) for s in ("free", "aimed", "met") for x in "NRo"}
    arcs |= {("free", "i"): (("free", "o", 1.0),), ("free", "I"): (("free", "M", 1.0),), ("free", "X"): (("free", "M", 1.0),), ("free", "T"): (("free", "o", 1.0),)}
    for s in ("aimed", "met"):
        arcs |= {(s, x): ((s, "M", TARGETED),) for x in "iI"}
        arcs |= {(s, "X"): (("met", "M", 1.0),), (s, "T"): (("met", "o", 1.0),)}
    begin = (("free", "E", 1.0), ("aimed", "E", 1.0))
    return Transducer(("free", "aimed"), arcs | {("free", "E"): begin, ("met", "E"): begin})


def negation() -> Transducer:
    """States: words left over which a negation lasts."""
    arcs = {}
    for left in range(NEGATION_SPAN + 1):
        after = max(left - 1, 0)
        arcs |= {(left, x): ((after, x, 1.0),) for x in "Ro"}
        arcs |= {(left, "N"): ((NEGATION_SPAN, "o", 1.0),), (left, "M"): ((after, "M", NEGATED if left else 1.0),), (left, "E"): ((0, "E", 1.0),)}
    return Transducer((0,), arcs)


def report() -> Transducer:
    """States: whether a reporting verb came in this clause."""
    arcs = {}
    for said in (False, True):
        arcs |= {(said, "o"): ((said, "o", 1.0),), (said, "R"): ((True, "o", 1.0),), (said, "M"): ((said, "M", REPORTED if said else 1.0),), (said, "E"): ((False, "E", 1.0),)}
    return Transducer((False,), arcs)


CASCADE = (threat, insult, target, negation, report)


def composed() -> Transducer:
    machine = CASCADE[0]()
    for one in CASCADE[1:]:
        machine = compose(machine, one())
    return machine


MACHINE = composed()


def features(word: str) -> list[str]:
    """The whole word (ended by $) and its beginnings, longest first."""
    return [word + "$", *(word[:k] for k in reversed(STEMS) if len(word) > k)]


def cost(weight: float) -> float:
    return -math.log1p(-min(weight, 0.99))


class Grammar:
    def __init__(self, weights: dict[str, float] | None = None):
        self.weights, self.symbols = weights or {}, {}

    def lexical(self, word: str) -> tuple[str, float]:
        """(symbol, weight) of a lower-case word; remembered."""
        found = self.symbols.get(word)
        if found is None:
            found = self._look_up(word)
            if len(word) <= WORD_LENGTH:
                self.symbols[word] = found
        return found

    def _look_up(self, word: str) -> tuple[str, float]:
        weight = max((self.weights.get(f, 0.0) for f in features(word)), default=0.0)
        if weight > 0:
            return "I", weight
        for symbol, words in (("H", THREATS), ("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS)):
            if word in words:
                return symbol, THREAT if symbol == "T" else 1.0
        return "o", 0.0

    def clauses(self, text: str) -> list[tuple[int, int, dict[str, float]]]:
        """(begin, end, cost of each word that matches) of the clauses that match, by the composed machine's best path."""
        out, begin, tokens, arcs = [], 0, [], MACHINE.arcs
        states = MACHINE.start
        for m in TOKEN.finditer(text + "\n"):
            t = m.group()
            if t not in ENDS:
                t = t.lower()
                tokens.append((t, *self.lexical(t)))
                continue
            tokens.append((t, "E", 0.0))
            # a clause without insult and threat verb only moves the clause count on
            live = any(s in "IH" for _, s, _ in tokens)
            paths = {s: (0.0, None) for s in states}
            for word, symbol, weight in tokens if live else tokens[-1:]:
                after: dict = {}
                for state, (total, met) in paths.items():
                    for following, written, gain in arcs.get((state, symbol), ()):
                        best = (total, met)
                        if written == "M":
                            c = cost(weight * gain)
                            best = (total + c, (word, c, met))
                        if following not in after or after[following][0] < best[0]:
                            after[following] = best
                paths = after
            _, met = max(paths.values(), key=lambda p: p[0])
            states, found = tuple(paths), {}
            while met:
                word, c, met = met
                found[word] = max(c, found.get(word, 0.0))
            if found:
                out.append((begin, m.start(), found))
            tokens, begin = [], m.end()
        return out

    def score(self, text: str | None) -> float:
        if len(self.symbols) > WORDS:
            self.symbols.clear()
        text = text or ""
        # a text without an insult or a threat verb has no matching clause
        if not any(self.lexical(w)[0] in "IH" for w in set(WORD.findall(text.lower()))):
            return 0.0
        best: dict[str, float] = {}
        for _, _, found in self.clauses(text):
            for word, c in found.items():
                best[word] = max(c, best.get(word, 0.0))
        return (1 - math.exp(-sum(best.values()))) ** SCORE_POWER


def _feature_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(feature, toxic, clean, docs): occurrences in toxic and clean texts, and toxic texts; "" stands for texts."""
    toxic, clean, docs = Counter(), Counter(), Counter()
    for batch in batches:
        for text, y in zip(batch["text"], batch["y"], strict=True):
            words, found = Counter(WORD.findall(text.lower())), Counter()
            for w, n in words.items():
                for f in features(w) if len(w) <= WORD_LENGTH else ():
                    found[f] = min(found[f] + n, A_TEXT)
            found[""] = 1
            (toxic if y else clean).update(found)
            if y:
                docs.update(found.keys())
    rows = [(f, n, clean[f], docs[f]) for f, n in toxic.items()] + [(f, 0, n, 0) for f, n in clean.items() if f not in toxic]
    yield pd.DataFrame(rows, columns=["feature", "toxic", "clean", "docs"])


def learn(docs: DataFrame, labels: DataFrame, held_out: tuple[int, int] = (4, 2)) -> Grammar:
    """A grammar from labelled rows outside the held-out fold, equal texts once; without labels, its own insults."""
    ship_package(docs.sparkSession)
    rows = training_sample(docs, labels, "toxic", held_out, TRAINING_ROWS).dropDuplicates(["text"])
    counts = rows.mapInPandas(_feature_counts, "feature string, toxic long, clean long, docs long").groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("toxic", "clean", "docs")])
    own = [f"{w}$" for w in INSULTS]
    # of what toxic texts never have, only the sum of all and the grammar's own words matter
    counts = Scratch(docs.sparkSession, "toxicity").cut(counts.filter((F.col("toxic") > 0) | F.col("feature").isin("", *own)), "counts")
    every = counts.filter("feature = ''").first()
    ratio = max(1, every.toxic) / max(1, every.clean) if every else 1.0
    share = F.col("toxic") / (F.col("toxic") + ratio * F.col("clean") + SHRINK)
    kept = counts.filter((F.col("feature") != "") & (F.col("docs") >= SUPPORT) & (F.col("toxic") >= OCCURRENCES)).withColumn("share", share).filter(F.col("share") >= LEAST)
    weights = {r.feature: float(r.share) ** SHARE_POWER for r in kept.orderBy(F.desc("toxic"), "feature").limit(ENTRIES).collect()}
    seen = {r.feature: (r.toxic, r.clean) for r in counts.filter(F.col("feature").isin(own)).collect()}
    for w in own:
        t, c = seen.get(w, (0, 0))
        weights[w] = max(weights.get(w, 0.0), ((t + OWN_SEEN * OWN) / (t + ratio * c + OWN_SEEN)) ** SHARE_POWER)
    return Grammar(weights)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, held_out: tuple[int, int] = (4, 2), train_docs: DataFrame | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 if score >= threshold) for every row of ``docs``.

    Labels are learned from ``train_docs`` (or ``docs``) outside the fold ``held_out``; scores read the text only.
    Null and empty texts score 0; a null id isn't held out; repeated ids are rows like others; without any label the
    grammar's own insults score.  An empty table gives no rows.  Of the other columns, those in
    ``keep`` are returned too, and the rest are not read.
    """
    grammar = learn(train_docs if train_docs is not None else docs, labels, held_out)
    shared, run_id = docs.sparkSession.sparkContext.broadcast(grammar.weights), uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = worker_state(("toxicity", run_id), lambda: Grammar(shared.value))
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    score = F.pandas_udf(run, "double")(F.coalesce("text", F.lit("")))
    out = docs.select(*keep, F.coalesce(crc_bucket("doc_id", held_out[0]) == held_out[1], F.lit(False)).alias("held_out"), score.alias("score"))
    return out.select("*", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))
