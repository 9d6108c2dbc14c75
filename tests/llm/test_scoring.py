"""Toxicity and line labels: held-out accuracy, counterfactuals, exact counts."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from siftward.llm import line_crf, quality, toxicity


@pytest.fixture(scope="module")
def judged(spark):
    """Sentences of which some are abusive; groups are named in both kinds."""
    rng = random.Random(1)
    plain = ["tree", "river", "walk", "paper", "seven", "blue", "window", "letter", "road", "music"]
    rude = ["scumface", "idiotic", "trashlike", "morons"]
    rows = []
    for i in range(1600):
        words = rng.choices(plain, k=rng.randint(5, 200))
        bad = rng.random() < 0.3
        if bad:
            words[rng.randrange(len(words))] = rng.choice(rude)
        if rng.random() < (0.9 if bad else 0.1):
            words.insert(rng.randrange(len(words)), "Muslims")
        rows.append((i, " ".join(words) + ".", int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], 1, r[2]) for r in rows], "doc_id long, quality int, toxic int")
    return docs, labels, rows


def test_held_out_accuracy(judged):
    docs, labels, rows = judged
    truth = {r[0]: r[2] for r in rows}
    found = toxicity.scored(docs, toxicity.train(docs, labels)).collect()
    assert {r.doc_id: r.held_out for r in found} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in truth}
    held = [r for r in found if r.held_out]
    right = sum(r.predicted == truth[r.doc_id] for r in held)
    assert len(held) > 300 and right / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_counterfactuals_narrow_the_gap_between_groups(judged):
    docs, labels, _ = judged
    sentence, other = b"tree river Muslims walk paper.", b"tree river Christians walk paper."
    free = toxicity.train(docs, labels, counterfactual=0.0)
    held = toxicity.train(docs, labels, counterfactual=3.0)
    gap = lambda m: abs(m.score(sentence) - m.score(other))
    assert gap(held) < gap(free) / 2
    assert held.score(sentence) < 0.3 < held.score(b"tree river idiotic walk.")


def test_swaps():
    swaps = toxicity.Swaps((("women", "men"),))
    assert swaps.counterfactual("The Women went. No one else".encode()) == {b"the", b"men", b"went", b"no", b"one", b"else"}
    assert swaps.counterfactual(b"nobody here") is None


def test_odd_rows_get_scores(judged, messy, messy_rows, no_docs):
    docs, labels, _ = judged
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(messy, model).collect()
    assert len(rows) == len(messy_rows) and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {False}
    empty = {r.score for r in rows if r.doc_id in (1, 2, 4)}
    assert len(empty) == 1
    assert toxicity.without_toxic(messy, model).columns == messy.columns
    assert toxicity.scored(no_docs, model).count() == 0


def test_without_labels_nothing_is_toxic(spark, messy, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for docs in (messy, no_docs):
        assert toxicity.scored(docs, toxicity.train(docs, none)).where("score <> 0 or predicted <> 0").count() == 0
    nulls = spark.createDataFrame([(None, 1, 1), (7, None, None), (9, 1, 0), (9, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.scored(messy, toxicity.train(messy, nulls)).count() == messy.count()


def test_score_depends_on_text_alone(spark, judged):
    docs, labels, _ = judged
    model = toxicity.train(docs, labels)
    twice = spark.createDataFrame([(5, "blue idiotic road", "de"), (6, "blue idiotic road", None)], "doc_id long, text string, lang string")
    assert len({r.score for r in toxicity.scored(twice, model).collect()}) == 1


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered, seen, dup = set(), set(), 0
    for k in range(len(words) - 7):
        if windows[tuple(words[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts(spark, messy_rows):
    rng = random.Random(3)
    rows = [(r[0], r[1]) for r in messy_rows]
    for i in range(40):
        line = " ".join(rng.choices(["a", "b#", "c|", "dd", "é"], k=rng.randint(1, 12)))
        other = " ".join(rng.choices(["a", "b#", "<x>"], k=rng.randint(0, 30)))
        rows.append((500 + i, "\n".join(rng.choices([line, line + " ", other, "", " "], k=rng.randint(1, 9)))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = quality.with_verdict(docs, line_crf.LineField()).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = sorted(((r.doc_id, *(r[n] for n in names)) for r in found), key=repr)
    assert got == sorted(((i, *counts(t)) for i, t in rows), key=repr)
    for r in found:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert r.kept == (not r.base_failed)


def test_decoding_finds_the_best_sequence():
    rng = np.random.default_rng(0)
    for _ in range(30):
        field = line_crf.LineField(rng.normal(size=(len(line_crf.FEATURES), 2)), rng.normal(size=(2, 2)))
        masks = rng.integers(0, 1 << len(line_crf.FEATURES), size=rng.integers(1, 8)).tolist()

        def total(labels):
            lines = sum(field.score(m)[y] for m, y in zip(masks, labels))
            return lines + sum(field.step[a, b] for a, b in zip(labels, labels[1:]))

        best = max(itertools.product((0, 1), repeat=len(masks)), key=total)
        assert total(field.decode(masks)) == pytest.approx(total(best))
    assert line_crf.LineField().decode([1, 1]) == [1, 1] and line_crf.LineField().decode([]) == []


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    scores, step = rng.normal(size=(3, 4, 2)), rng.normal(size=(2, 2))
    wanted, length = rng.integers(0, 2, size=(3, 4)), np.array([4, 2, 1])

    def loss(s, t):
        out = 0.0
        for k, n in enumerate(length):
            value = lambda y: sum(s[k, i, y[i]] for i in range(n)) + sum(t[y[i], y[i + 1]] for i in range(n - 1))  # noqa: B023, E731
            out += np.log(sum(np.exp(value(y)) for y in itertools.product((0, 1), repeat=n))) - value(wanted[k, :n])
        return out

    lines, steps = line_crf.expected_less_wanted(scores, step, wanted, length)
    for grad, at in ((lines, scores), (steps, step)):
        for place in np.ndindex(at.shape):
            moved = at.copy()
            moved[place] += 1e-6
            change = loss(moved, step) if at is scores else loss(scores, moved)
            assert (change - loss(scores, step)) / 1e-6 == pytest.approx(grad[place], abs=1e-4)


def test_verdict_on_held_out_documents(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 8)))
    rows = []
    for i in range(600):
        good = i % 3 > 0
        lines = []
        for _ in range(rng.randint(3, 9)):
            if good:
                lines.append(" ".join(word() for _ in range(rng.randint(8, 25))).capitalize() + ".")
            else:
                lines.append(" ".join(f"{word()} |" if rng.random() < 0.7 else f"{word().upper()}!!" for _ in range(rng.randint(6, 12))))
        rows.append((i, "\n".join(lines), int(good)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows[:300]], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.kept for r in quality.with_verdict(docs, quality.fit_field(docs, labels)).collect()}
    right = sum(found[i] == bool(good) for i, _, good in rows[300:])
    assert right / 300 > 0.97


def test_no_labels_and_no_documents(spark, messy, no_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.with_verdict(messy, quality.fit_field(messy, none)).where("kept = base_failed").count() == 0
    assert quality.with_verdict(no_docs, quality.fit_field(no_docs, none)).count() == 0
