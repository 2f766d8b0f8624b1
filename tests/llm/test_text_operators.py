"""Main content, preference format, decontamination, classifiers, mixing and the pipeline."""

import math
import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from termloom.llm import decontaminate, maincontent, mixing, preference, quality, toxicity

R = random.Random(8)
SYLLABLES = ["ba", "ko", "mi", "ter", "lu", "sen", "dor", "pa", "vi", "ze"]


def prose(n, r=R):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randrange(1, 4))) for _ in range(n))


# --- main content ---------------------------------------------------------------------------------

PAGE = (
    "<!DOCTYPE html><html><head><title>T t t</title><style>p{{}}</style><script>var t='<p>';</script></head><body>"
    "<nav><ul><li><a href='/a'>Menu one</a></li><li>two</li></ul></nav><div class=ad>Buy now</div>"
    "<{tag}><h1>Head &amp; line</h1><p><b>First\n\tpara &#233;<br>goes on<p>Second</p><aside>See also</aside>{more}</{tag}>"
    "<div class='comments'>Nice read</div><footer>&copy; me</footer></body>"
)


def test_main_text(spark):
    text = "Head & line\n\nFirst para é goes on\n\nSecond\n\n" + "\n\n".join(f"Para {i} of some more words" for i in range(9))
    more = "".join(f"<p>Para {i} of some more words</p>" for i in range(9))
    rows = [(i, PAGE.format(tag="article", more=more), "kept?") for i in range(30)]
    rows += [(50, PAGE.format(tag="div", more=more), None), (51, None, None), (52, "", None), (53, "<div", None)]
    rows += [(54, "<p>" + "long " * 300_000, None), (None, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, n_chars string")
    found = maincontent.main_content(frame)
    assert found.columns == ["page_id", "text", "n_chars"]
    found = {r.page_id: r for r in found.collect()}
    assert found[0].text == found[50].text == found[None].text == text and found[0].n_chars == len(text)
    assert found[51].text == found[52].text == "" and found[54].n_chars == 300_000 * 5 - 1
    assert maincontent.main_content(frame.limit(0)).count() == 0


def test_best_region_against_all_intervals():
    r = random.Random(21)
    for _ in range(200):
        scores = [r.choice([-3.0, -1.0, -0.05, 0.0, 1.0, 2.5]) for _ in range(r.randrange(0, 25))]
        first, last = maincontent.best_region(scores)
        best = max((sum(scores[i:j]) for i in range(len(scores)) for j in range(i, len(scores) + 1)), default=0.0)
        assert sum(scores[first:last]) == pytest.approx(max(best, 0.0))


WORDS = " ".join(f"w{i}" for i in range(100))


@pytest.mark.parametrize("learned", [True, False])
def test_names_are_weighed_against_words(learned):
    pages = [PAGE.format(tag="article", more=f"<p>{WORDS}</p>")] * 30
    weights = maincontent.weights_of(maincontent.counts_of(pages)) if learned else {}
    text = lambda page: maincontent.main_text(page, weights)
    assert text(f"<article><h1>T</h1><div class='search results'>{WORDS}</div></article>") == f"T\n\n{WORDS}"
    assert text(f"<body><div class='related-work'><p>{WORDS}</p></div></body>") == WORDS
    assert text("<article><h1>The head</h1><p>Some words</p><div class='share-price'><p>The price rose.</p></div></article>").endswith("The price rose.")
    furniture = (
        f"<aside>{WORDS}</aside><div class='comments'><p>{WORDS}</p><p>Nice</p></div><div class=notice>We use it</div>"
        "<div class='related-posts'><a href=x>one two three</a></div><div id='ad-slot'><p>Buy</p></div><form>Your name</form>"
    )
    page = f"<nav>a b</nav><article><header><h1>Head</h1></header><p>{WORDS}</p>{furniture}<p>{WORDS} end</p></article><footer>f</footer>"
    assert text(page) == f"Head\n\n{WORDS}\n\n{WORDS} end"


@pytest.mark.parametrize(
    "page", ["<a x" * 250_000, "if a <b and c " * 70_000, "<div>" * 50_000 + "</p>" * 50_000, '<a x="' * 150_000, "<svg>" * 100_000,
             "<div class=ad>" * 40_000 + "</li>" * 40_000, "</div" * 200_000, "<!--" * 200_000]
)
def test_malformed_pages_take_linear_time(page):
    begun = time.process_time()
    maincontent.main_text(page, {})
    assert time.process_time() - begun < 8


def test_text_that_looks_like_markup_stays():
    assert maincontent.main_text("<p>if a <b and c < d & e</p><p>x <3 y", {}) == "if a <b and c < d & e\n\nx <3 y"
    assert maincontent.main_text("<p>one <svg> two <object>three", {}) == "one two three"
    assert maincontent.main_text("<p title='a > b'>one</p><script>1 < 2</script>two<style>x", {}) == "one\n\ntwo"


# --- preference format ------------------------------------------------------------------------------


def test_preference_format(spark):
    turns = lambda *x: [(r, t) for r, t in x]
    a, b, c = ("user", "q"), ("assistant", "yes <|im_end|>"), ("assistant", "né")
    rows = [
        (1, turns(a, b), turns(a, c), "x"), (2, turns(a, b, a), turns(a, b), "x"), (3, None, turns(c), "x"),
        (4, [], [], "x"), (5, turns(b), turns(b), "x"), (6, turns(a, b, a, c), turns(c, a), "x"),
    ]
    side = "array<struct<role:string,text:string>>"
    frame = spark.createDataFrame(rows, f"id int, chosen {side}, rejected {side}, prompt string")
    out = {r.id: r for r in preference.preference_format(frame).collect()}
    shown = lambda t: "".join(f"<|im_start|>{r}\n{x.replace('<|im_end|>', '<| im_end |>')}<|im_end|>\n" for r, x in t)
    for key, chosen, rejected, _ in rows:
        chosen, row = chosen or [], out[key]
        n = next((i for i, (p, q) in enumerate(zip(chosen, rejected)) if p != q), min(len(chosen), len(rejected)))
        assert row.n_common == n and row.prompt == shown(chosen[:n])
        for text, mask, rest in ((row.chosen, row.chosen_mask, chosen[n:]), (row.rejected, row.rejected_mask, rejected[n:])):
            assert text == shown(rest)
            spans = [text[s.start : s.start + s.length] for s in mask]
            assert spans == [shown([t])[len("<|im_start|>assistant\n") : -1] for t in rest if t[0] == "assistant"]


def test_preference_format_keeps_missing_turns(spark):
    a, b = ("user", "q"), ("assistant", "yes")
    rows = [
        (1, [a, None, b], [a, ("", ""), ("assistant", None)]),
        (2, [("user", None), ("assistant", None)], [("user", ""), (None, "x")]),
        (3, [None], []),
        (4, [a, b] * 600, [a, b] * 500 + [b]),
    ]
    side = "array<struct<role:string,text:string>>"
    frame = spark.createDataFrame(rows, f"id int, chosen {side}, rejected {side}")
    found = {r.id: r for r in preference.preference_format(frame).collect()}
    turn = lambda t: f"<|im_start|>{(t and t[0]) or ''}\n{(t and t[1]) or ''}<|im_end|>\n"
    for key, chosen, rejected in rows:
        row = found[key]
        left, right = [turn(t) for t in chosen], [turn(t) for t in rejected]
        n = next((i for i, (p, q) in enumerate(zip(left, right)) if p != q), min(len(left), len(right)))
        assert (row.n_common, row.prompt, row.chosen, row.rejected) == (n, "".join(left[:n]), "".join(left[n:]), "".join(right[n:]))
        for text, mask, turns in ((row.chosen, row.chosen_mask, chosen[n:]), (row.rejected, row.rejected_mask, rejected[n:])):
            spans = [text[s.start : s.start + s.length] for s in mask]
            assert spans == [turn(t)[len("<|im_start|>assistant\n") : -1] for t in turns if t and t[0] == "assistant"]
    assert preference.preference_format(frame.limit(0)).count() == 0


def test_reply_pairs(spark):
    rows = [(0, 0, "user", "q"), (0, 1, "assistant", "a"), (0, 2, "user", "z"), (1, 0, None, None), (1, 1, "assistant", "b"),
            (2, 0, "assistant", "c"), (4, 0, "user", "n"), (5, 0, "assistant", "m"), (None, 0, "user", "x")]
    found = {r.conv_id: (r.chosen, r.rejected) for r in preference.reply_pairs(
        spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).collect()}
    assert set(found) == {0, 1}
    assert [tuple(t) for t in found[0][1]] == [("user", "q"), ("assistant", "b")]
    assert [tuple(t) for t in found[1][1]] == [("", ""), ("assistant", "a")]


# --- decontamination ------------------------------------------------------------------------------------


@pytest.mark.parametrize("at_once", [5_000, 3])
def test_leaks_against_brute_force(spark, monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "ITEMS_AT_ONCE", at_once)
    r = random.Random(3)
    items = [(i, prose(r.randrange(12, 40), r).capitalize() + "?\n" + prose(r.randrange(2, 9), r)) for i in range(24)]
    items += [(90, None), (91, " . "), (None, "x y z"), (92, "Only one sentence here of words")]
    docs = [(0, None), (1, ""), (2, prose(30_000, r) + " " + items[5][1].upper().replace(" ", "\n") + " " + prose(500, r))]
    docs += [(3, items[3][1].split("\n")[0]), (3, items[3][1]), (None, items[4][1])]
    for i in range(4, 60):
        own = prose(r.randrange(5, 300), r)
        docs.append((i, r.choice([own, own + ", " + r.choice(items[:24])[1] + "! " + own])))
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, leaks int")
    out = decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string").withColumn("more", F.lit(1)))
    assert out.columns == ["doc_id", "text", "leaks"]
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t or "").split()
    grams = lambda w, n=5: {tuple(w[i : i + min(n, len(w))]) for i in range(max(1, len(w) - n + 1))} if w else set()

    def held(text, item):
        for part in decontaminate.question_and_answer(item):
            wanted = grams(words(part))
            size = len(next(iter(wanted))) if wanted else 1
            if wanted and len(wanted & grams(words(text), size)) < 0.8 * len(wanted):
                return False
        return True

    wanted = sorted(
        (str(d), t or "", [i for i, x in items if i is not None and x and words(x) and held(t, x)]) for d, t in docs
    )
    found = sorted((str(x.doc_id), x.text or "", sorted(y.item_id for y in x.leaks)) for x in out.collect())
    assert found == wanted
    assert decontaminate.leaks(frame, spark.createDataFrame([], "item_id long, text string")).where(F.size("leaks") > 0).count() == 0


def test_leaks_of_short_questions_against_brute_force(spark):
    r = random.Random(13)
    own = lambda i, part, n: " ".join(f"{part}{i}w{k}" for k in range(n))
    items = [(n * 10 + m, own(n * 10 + m, "q", n).capitalize() + "?\n" + own(n * 10 + m, "a", m)) for n in range(1, 6) for m in (1, 3, 7)]
    items += [(100 + n, own(n, "s", n) + ". " + own(n, "t", 9) + "!") for n in range(1, 6)] + [(110, "Lone"), (111, "Two lone")]
    parts = [decontaminate.question_and_answer(t) for _, t in items]
    docs = [prose(50, r) + " " + t.upper().replace("\n", " ") + " " + prose(200, r) for _, t in items]
    docs += [f"{prose(9, r)} {part} {prose(9, r)}" for pair in parts for part in pair]
    docs += [f"{q} {' '.join(reversed(a.split()))}" for q, a in parts] + [f"{' '.join(reversed(q.split()))} {a}" for q, a in parts]
    words = lambda t: "".join(c.lower() if c.isalnum() else " " for c in t).split()

    def share(text, part):
        wanted, have = words(part), words(text)
        n = min(5, len(wanted))
        cut = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        return len(cut(wanted) & cut(have)) / len(cut(wanted)) if wanted else 1.0

    wanted = [[i for (i, _), pair in zip(items, parts) if all(share(d, x) >= 0.8 for x in pair)] for d in docs]
    assert all(i in w for (i, _), w in zip(items, wanted))
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    out = decontaminate.leaks(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert [sorted(y.item_id for y in x.leaks) for x in sorted(out.collect(), key=lambda x: x.doc_id)] == [sorted(w) for w in wanted]


def test_leaks_of_items_without_id(spark):
    items = [(None, "Which river runs here?\nThe long one"), (None, "Other text of nobody?\nNo"), (1, "Which river runs here?\nThe long one")]
    docs = [(0, "so: which river runs here? the long one, yes"), (1, "nothing"), (2, "Other text of nobody? No")]
    out = decontaminate.leaks(
        spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    )
    found = {x.doc_id: sorted((y.item_id for y in x.leaks), key=str) for x in out.collect()}
    assert found == {0: [1, None], 1: [], 2: [None]}


# --- classifiers ---------------------------------------------------------------------------------------


def test_toxicity_of_held_out_documents(spark):
    r = random.Random(5)
    rows = []
    for i in range(600):
        text = ". ".join(prose(9, r) for _ in range(r.randrange(1, 30)))
        bad = i % 5 == 0
        rows.append((i, text + (". You " + r.choice(["grumbler", "Vextron", "vextrus"]) + " there. " if bad else ". ") + prose(5, r), int(bad)))
    docs = spark.createDataFrame([(i, t, "c") for i, t, _ in rows] + [(None, None, "c"), (9000, "", "c")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels, toxicity.learnable())
    assert out.columns == ["doc_id", "text", "score", "offending"]
    found = {x.doc_id: x for x in out.collect()}
    assert all((found[i].score >= toxicity.CUT) == bool(y) for i, _, y in rows)
    assert all(any("You" in s for s in found[i].offending) for i, _, y in rows if y)
    assert found[9000].score == found[None].score == 0.0
    none = toxicity.toxicity(docs, labels.limit(0), toxicity.learnable())
    assert none.where("score >= 0.7").count() == 0 and toxicity.toxicity(docs.limit(0), labels, toxicity.learnable()).count() == 0


def test_toxicity_learns_from_the_end_of_long_texts(spark):
    r = random.Random(15)
    rows = []
    for i in range(240):
        text = ". ".join(prose(9, r) for _ in range(250))
        assert len(text) > 10_000
        rows.append((i, text + (". You " + r.choice(["grumbler", "Vextron"]) + " there." if i % 4 == 0 else "."), int(i % 4 == 0)))
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    found = {x.doc_id: x for x in toxicity.toxicity(docs, labels, toxicity.learnable()).collect()}
    assert all((found[i].score >= toxicity.CUT) == bool(y) for i, _, y in rows)
    assert all(any("You" in s for s in found[i].offending) for i, _, y in rows if y)


def test_toxicity_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []
    learn = toxicity.learn
    monkeypatch.setattr(toxicity, "learn", lambda sample: (seen.append(sample.collect()), learn(sample))[1])
    rows = [(1, f"text number {i}") for i in range(500)] + [(1, "the same")] * 500 + [(2, "clean one"), (2, None), (4, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (2, 5), (4, 0)], "doc_id long, toxic int")
    out = toxicity.toxicity(docs, labels, F.lit(True), fit_rows=2)
    assert out.count() == len(rows)
    assert sorted(x.label for x in seen[0]) == [0, 0, 1, 1] and len({x.text for x in seen[0] if x.label}) == 2


def test_noisy_or_against_brute_force():
    r = np.random.default_rng(4)
    texts = [". ".join(" ".join(r.choice(["ab", "cd", "Ef", "gh", "éi"], 4)) for _ in range(r.integers(0, 5))) for _ in range(40)]
    texts[3], labels = "", r.integers(0, 2, 40)
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    bags = toxicity.bags_of(data, np.append(0, np.cumsum([len(t.encode()) for t in texts])))
    known = np.unique(bags.features[0])[:-1]  # of one word nothing is known
    weights = np.append(r.normal(size=len(known)) * 3, 0.0)
    model = toxicity.Model(known, weights, -2.0)
    own = {w: toxicity.bags_of(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).features[0, 0] for w in ("ab", "cd", "ef", "gh", "éi")}
    weight = {w: dict(zip(known.tolist(), weights)).get(int(h), 0.0) for w, h in own.items()}
    scores = model.scores(toxicity._none_toxic(bags, model.logits(bags)))
    for text, score in zip(texts, scores):
        none = 1.0
        for sentence in text.lower().split(". "):
            if sentence:
                none *= 1 - 1 / (1 + math.exp(2 - sum(weight[w] for w in sentence.split())))
        wanted = 0.0 if not text else 1 / (1 + none / (1 - none) * 0.3 / 0.7)
        assert score == pytest.approx(wanted, abs=1e-9)
    places = toxicity._places(known, bags.features[0])
    hit = places < len(known)
    found = toxicity.Known(places[hit].astype(np.int64), bags.sentence_of_word[hit], bags.doc_of_sentence, bags.docs)
    _, gradient = toxicity.loss_of(weights, found, labels, 0.01)
    for i in range(len(known)):
        step = np.zeros(len(weights))
        step[i] = 1e-5
        ahead, behind = (toxicity.loss_of(weights + sign * step, found, labels, 0.01)[0] for sign in (1, -1))
        assert gradient[i] == pytest.approx((ahead - behind) / 2e-5, abs=1e-6)


def test_quality_of_held_out_documents(spark):
    r = random.Random(6)
    rows = [(i, prose(80, r) + "." if i % 4 else prose(30, r).upper() + "!! " + "spam " * r.randrange(20, 60), int(i % 4 > 0)) for i in range(400)]
    docs = spark.createDataFrame([x[:2] for x in rows] + [(None, None), (9000, ""), (9001, "a " * 400_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    out = quality.quality(docs, labels, quality.learnable())
    found = {x.doc_id: x.score for x in out.collect()}
    assert np.mean([(found[i] >= quality.CUT) == bool(y) for i, _, y in rows]) > 0.99
    assert all(0 <= s <= 1 for s in found.values()) and len(found) == 403
    assert quality.quality(docs.limit(0), labels, quality.learnable()).count() == 0


def test_quality_cut_is_the_quantile_of_all_labelled_rows(spark):
    r = random.Random(16)
    rows = [(i, prose(r.randrange(20, 90), r) + r.choice([".", "!", " #", "\n"]) * r.randrange(1, 9), int(i % 10 > 0)) for i in range(600)]
    docs = spark.createDataFrame([x[:2] for x in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    out = quality.quality(docs, labels, quality.learnable(), fit_rows=40).where(quality.learnable())
    below = out.where(F.col("score") < quality.CUT).count()
    bad = labels.where(quality.learnable()).where("quality = 0").count()
    assert abs(below - bad) <= 2


def test_quality_cut_of_ordered_keys(spark):
    r = np.random.default_rng(3)
    values = np.append(np.round(r.normal(size=500), 1), [0.0, -0.0, 1e300, -1e300, -1e-300])
    keys = spark.createDataFrame([(int(k),) for k in quality._ordered(values)], "key long")
    s = np.sort(values)
    for at in (1, 40, 250, len(s) - 1, len(s)):
        assert quality._cut(keys, at) == (s[at - 1] + s[min(at, len(s) - 1)]) / 2


# --- mixing --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("budget", "entropy", "repeats"), [(None, 0.9, 4.0), (20_000, 0.95, 100.0), (500, 0.2, 4.0)])
def test_mixture_follows_the_weights(spark, budget, entropy, repeats):
    r = random.Random(7)
    rows = [(i, prose(r.randrange(1, 60), r), "hot" if i % 3 else f"s{r.randrange(6)}") for i in range(300)]
    rows += [(900, None, "hot"), (901, " ", "void"), (None, "one two", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*x, 0) for x in rows], "doc_id long, text string, source string, epoch int")
    out = mixing.mixture(docs, budget, entropy, repeats)
    assert out.columns == ["doc_id", "text", "source", "n_tokens", "weight", "epoch", "place"]
    draws = out.collect()
    tokens, size = defaultdict(int), {}
    for _, t, s in rows:
        tokens[s] += len((t or "").split())
    total = sum(tokens.values())
    tokens = {s: n for s, n in tokens.items() if n}
    budget = budget or total
    weight = {d.source: d.weight for d in draws}

    def of(a):
        z = sum((n / total) ** a for n in tokens.values())
        return {s: (n / total) ** a / z for s, n in tokens.items()}

    enough = [a / 2000 for a in range(2001) if -sum(p * math.log(p) for p in of(a / 2000).values()) >= entropy * math.log(len(tokens))]
    few = [a / 2000 for a in range(2001) if max(p * budget / tokens[s] for s, p in of(a / 2000).items()) <= repeats]
    alpha = max(max(enough, default=0), min(few, default=1))
    assert all(abs(weight[s] - p) < 2e-3 for s, p in of(alpha).items() if s in weight)
    by_source = defaultdict(list)
    for d in draws:
        by_source[d.source].append(d)
    for s, own in by_source.items():
        wanted = round(weight[s] * budget)
        size = sum(d.n_tokens for d in own)
        longest = max(len((t or "").split()) for _, t, x in rows if x == s)
        assert wanted <= size < wanted + longest or abs(size - wanted) <= longest
        at = 0
        for d in sorted((d for d in own if d.n_tokens), key=lambda d: d.place):
            assert d.place == at
            at += d.n_tokens
        whole = max(d.epoch for d in own)
        for epoch in range(whole):  # each whole epoch draws every document once
            assert sum(d.n_tokens for d in own if d.epoch == epoch) == tokens[s]


def test_mixture_of_nothing(spark):
    assert mixing.mixture(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# --- pipeline --------------------------------------------------------------------------------------------


def test_pipeline_keeps_what_is_clean(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(11)
    items = [(i, prose(30, r)) for i in range(5)]
    texts, toxic = [], []
    for i in range(240):
        bad = i % 8 == 0
        text = ". ".join(prose(60, r) for _ in range(4)) + (". You grumbler." if bad else ".")
        texts.append(text)
        toxic.append(int(bad))
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(texts)]
    passage = prose(60, r)
    rows += [(300, texts[1], "en", "s0", 1), (301, texts[1].replace("ba", "BA", 1), "en", "s0", 1), (302, prose(90, r) + " " + items[2][1], "en", "s1", 1)]
    rows += [(303, prose(200, r) + " " + passage, "en", "s1", 1), (304, passage + " " + prose(200, r), "en", "s1", 1), (305, None, None, None, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, 1, y) for i, y in enumerate(toxic)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(corpus_pipeline.STAGES) == 5
    kept = [set() for _ in corpus_pipeline.STAGES]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"out-{n}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        kept[n] = {x.doc_id for x in docs.collect()}
    everything = {x[0] for x in rows}
    assert kept[0] == everything - {i for i in range(240) if toxic[i]}
    assert kept[0] - kept[1] == {300, 301}
    assert kept[2] == kept[1] and kept[2] - kept[3] == {302}
    left = {x.doc_id: x for x in docs.collect()}
    assert passage in left[303].text and passage not in left[304].text and left[304].n_chars == len(left[304].text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0


def test_near_dedup_keeps_a_row_of_each_group(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(17)
    t = [prose(120, r) for _ in range(9)]
    rows = [(None, t[0], "a"), (None, t[1], "a"), (None, t[2], "a"), (None, t[2].upper(), "b")]  # unlinked texts without id, and a copy
    rows += [(5, t[3], "a"), (5, t[4], "a"), (6, t[3], "a"), (6, t[5], "a"), (5, t[4], "a")]  # ids with several texts
    rows += [(None, t[6], "a"), (8, t[6], "a"), (9, None, "a"), (None, "", "a")]
    out = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string, source string"), "")
    assert out.columns == ["doc_id", "text", "source"]
    found = sorted((str(x.doc_id), (x.text or "").lower()) for x in out.collect())
    assert found == sorted([*(("None", x) for x in t[:3]), ("5", t[3]), ("5", t[4]), ("6", t[5]), ("8", t[6]), ("9", "")])


def test_stages_keep_own_columns_and_marks(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(27)
    passage, end = prose(40, r), " \ufffe \ufffd1 " + prose(30, r)
    # the second bytes of both letters before the passage are equal, so one letter is cut through
    texts = ["q\ufffdr " + prose(30, r) + "é" + passage + "\ufffe0\ufffe1", "\ufffd ĩ" + passage + end, "", None]
    made = ("score", "offending", "_a", "_b", "n_units", "n_removed", "n_spans", "kept", "leaks")
    rows = [(i, t, "s", *(f"{c} {i}" for c in made)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in made))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "no such question?\nnone")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "source", *made]
        assert all(x[c] == f"{c} {x.doc_id}" for x in docs.collect() for c in made)
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    found = {x.doc_id: x.text for x in docs.collect()}
    assert found[0] == texts[0] and len(found) == 3
    assert found[1] == "\ufffd " + end


def test_toxicity_holds_few_words_at_once(monkeypatch):
    """What is made of the words takes many times their room, so a batch is taken in small chunks."""
    most = []
    plain = toxicity.bags_of
    monkeypatch.setattr(toxicity, "bags_of", lambda data, bounds: most.append(len(data)) or plain(data, bounds))
    texts = ["some plain words. " * 1000] * 300
    model = toxicity.Model(np.zeros(0, np.uint64), np.zeros(1), toxicity.BIAS)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(300)), "text": texts})
    (found,) = toxicity._score(model, iter([batch]))
    assert found.num_rows == 300 and max(most) <= 1 << 19 and sum(most) == 300 * 18_000
