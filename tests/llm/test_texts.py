from collections import Counter

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from marginalia.llm import leakage as L
from marginalia.llm import mixing as M
from marginalia.llm import pair_defects as D
from marginalia.llm import scan_noise as N
from marginalia.llm import sentences as S


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_tiles_match_and_do_not_overlap(a, b):
    seen_a, seen_b = set(), set()
    for i, j, k in L.tiles(a, b):
        assert k >= L.TILE and a[i:i + k] == b[j:j + k]
        ra, rb = set(range(i, i + k)), set(range(j, j + k))
        assert not ra & seen_a and not rb & seen_b
        seen_a |= ra
        seen_b |= rb
    assert len(seen_a) <= sum(L._common_runs(a, b, L.TILE))


def test_reordered_passage_is_covered_but_is_no_run():
    p = [f"w{i}" for i in range(40)]
    d = ["x"] + p[20:] + ["y"] * 9 + p[:20]
    t = L.tiles(p, d)
    assert sum(k for _, _, k in t) == 40 and L.longest_run(t)[0] == 20


def test_changed_words_do_not_break_a_run():
    p = [f"w{i}" for i in range(40)]
    d = [w if i % 9 != 4 else "?" for i, w in enumerate(p)]
    assert L.longest_run(L.tiles(p, d))[0] >= 36


def test_shared_instruction_is_left_out_but_copies_stay_whole(spark):
    items = [(i, f"Read this well. Passage number {i} of the set.") for i in range(4)] + [(9, "Alone it stands. And more.")] + [(20 + i, "Thrice it comes. With the same rest.") for i in range(3)] + [(30, None), (31, "")]
    got = {r.item_id: r.passage for r in L.without_instruction(spark.createDataFrame(items, "item_id long, passage string")).collect()}
    assert L.words(got[0]) == ["passage", "number", "0", "of", "the", "set"] and L.words(got[9])[0] == "alone"
    assert L.words(got[20])[0] == "thrice" and 30 not in got


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=3, max_size=12), min_size=1, max_size=5), st.lists(st.integers(0, 5), min_size=3, max_size=30))
def test_bound_on_what_tiles_hold(passages, doc):
    ix = L.Index([(n, [str(w) for w in p]) for n, p in enumerate(passages)])
    import numpy as np

    text = np.array([ix.number.get(str(w), 0) for w in doc])
    runs = ix.runs(text)
    held = ix.held(runs[np.isin(runs, ix.run) & (runs != 0)])
    assert len(held) == len(passages)
    for n, p in enumerate(passages):
        assert held[n] >= sum(k for _, _, k in L.tiles([str(w) for w in p], [str(w) for w in doc]))


def test_leaks_block_by_block(spark, monkeypatch):
    import random

    rng = random.Random(3)
    make = lambda n: [f"w{rng.randint(0, 3000)}" for _ in range(n)]
    items = [(i, make(40)) for i in range(12)]
    docs = [(i, " ".join(make(60) + (p[:25] if i % 2 else p[20:]) + make(30)).upper()) for i, p in items]
    # A change at every fourth word, and another order.
    docs += [(100, " ".join(w if k % 4 else "zz" for k, w in enumerate(items[0][1]))), (101, " ".join(items[1][1][20:] + ["x"] * 9 + items[1][1][:20])), (102, None), (103, ""), (104, "short")]
    want = {(i, i) for i in range(12)} | {(100, 0)}
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id long, passage string")
    for block in (8_000_000, 500):
        monkeypatch.setattr(L, "BLOCK", block)
        rows = L.leaks(*frames).collect()
        assert {(r.doc_id, r.item_id) for r in rows if r.run >= 0.5 and r.held >= 0.35} == want | {(101, 1)}
        assert {(r.doc_id, r.item_id) for r in rows if r.coverage >= 0.9} == {(101, 1)}


@settings(max_examples=200, deadline=None)
@given(st.floats(0.01, 0.99), st.integers(1, 50), st.floats(0.01, 0.99), st.integers(1, 50), st.floats(0, 0.999999))
def test_pivot_keeps_weight(pi, wi, pj, wj, u):
    a, b = M.pivot(pi, wi, pj, wj, u)
    assert abs(wi * a + wj * b - wi * pi - wj * pj) < 1e-6
    assert a in (0.0, 1.0) or b in (0.0, 1.0)


def test_rounding_keeps_totals_over_a_tree(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET", 10)
    rows = [("s" if i % 3 else "t", i, 1 + i % 7, 0.37) for i in range(900)]
    out = M.dependent_rounding(spark.createDataFrame(rows, "source string, id long, w long, p double"), len(rows)).collect()
    assert len(out) == 900
    for s in "st":
        want = sum(w * p for x, _, w, p in rows if x == s)
        assert abs(sum(r.w * r.up for r in out if r.source == s) - want) <= 7


def test_mix_reports_shares_and_what_falls_short(spark):
    docs = [(i, " Big " if i < 90 else "small", "one two three four five " * 5) for i in range(100)] + [(200, None, "x"), (201, "small", None)]
    targets = [("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.1, 3), ("zero", 0.0, 1)]
    copies, report = M.mix(spark.createDataFrame(docs, "id long, source string, text string"), spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    assert {r.source for r in report.filter("short").collect()} == {"small", "none"}
    assert {r.copies for r in copies.filter("source = 'small' and tokens > 0").collect()} == {2}


def model(texts):
    out = []
    for x in S._observer(iter([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])])):
        out += [tuple(r.values()) for r in x.to_pylist()]
    return S.Model(out)


def _training():
    """Paragraphs of sentences in random order, so that each ends some paragraph."""
    import random

    rng = random.Random(6)
    pool = ["The survey of Dr. Ames was short.", "It covered e.g. the north of St. Tove in autumn.", "Each table was read by J. K. Olsen again.", "A second part followed, with maps, etc.", "Nobody complained about approx. 3.5 units of it.", "He stayed at the coast.", "They wrote a longer report."]
    out = []
    for _ in range(250):
        out.append("\n\n".join(" ".join(rng.sample(pool, 4)) for _ in range(2)))
    return out + ["記録には「旧版は問いを区別できる。旧版は予測した。」とある。次の文が続く。\n\n新しい段落だ。"] * 30


TRAINING = _training()


@pytest.mark.parametrize("text, parts", [
    ("Dr. Ames came at last. He left.", ["Dr. Ames came at last.", "He left."]),
    ('She wrote: "It rained. It stopped." The end came.', ['She wrote: "It rained. It stopped."', "The end came."]),
    ("We read v2.7 of it, e.g. the table. Done?! Yes.", ["We read v2.7 of it, e.g. the table.", "Done?!", "Yes."]),
    ("3.1 Methods\nThe table was read by J. K. Olsen again. It was short.", ["3.1 Methods", "The table was read by J. K. Olsen again.", "It was short."]),
    ("记录如下。第二句！第三句", ["记录如下。", "第二句！", "第三句"]),
    ("旧版は「問い。答え。」とある。次の文が続く。", ["旧版は「問い。答え。」とある。", "次の文が続く。"]),
    ("งานวิจัยนี้ลดความหนาแน่น แบบจำลองของ Temohisos ทำนาย กลุ่มควบคุม", ["งานวิจัยนี้ลดความหนาแน่น", "แบบจำลองของ Temohisos ทำนาย", "กลุ่มควบคุม"]),
    ("no boundary here", ["no boundary here"]), ("   ", []), ("", []),
])
def test_sentences(text, parts):
    m = model(TRAINING)
    ends = m.ends(text)
    starts = [0, *ends[:-1]]
    assert [text[a:b].strip() for a, b in zip(starts, ends)] == parts


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB. \n\"“”(」。「1ก", max_size=60))
def test_sentences_cover_the_text(text):
    ends = model(TRAINING[:5]).ends(text)
    assert ends == sorted(set(ends))
    assert not text.strip() or ends[-1] == len(text.rstrip())


def test_words_are_told_apart_however_many_there_are(spark):
    """20,300 abbreviations, each four times; the last in the alphabet is read as the first is, and not as words that end sentences."""
    letters = "bcdfghjklmnprstvwxyz"
    words = sorted(a + b + c + d for a in letters for b in letters for c in letters for d in letters)[:20_300]
    texts = []
    for i in range(0, len(words), 5):
        some = " ".join(f"They saw the old {w}. tolmar" for w in words[i:i + 5]) + " again afterwards."
        texts.append(("\n\n".join([some] * 4 + ["Nothing else happened to them afterwards."] * 4),))
    m = S.train(spark.createDataFrame(texts, "text string").repartition(4))
    for w in (words[0], words[10_000], words[-1]):
        text = f"They saw {w}. tolmar again afterwards."
        assert m.ends(text) == [len(text)]


def test_counts_of_the_corpus_give_the_model_of_counts_in_memory(spark):
    rows = spark.createDataFrame([(t,) for t in TRAINING], "text string").repartition(3)
    one, other = S.train(rows), model(TRAINING)
    assert {k: list(v) for k, v in one.far.items()} == {k: list(v) for k, v in other.far.items()}
    seen = {(before, what) for t in TRAINING for _, before, what, _, _ in S.gaps(t)} | {("unseen\tdot\t", "blank\tupper\tunseen"), ("a\tdots\t”+", "none\t%\t")}
    assert {k: one.score(*k) for k in seen} == {k: other.score(*k) for k in seen}


def joined(parts, sep):
    ends, at = [], 0
    for p in parts:
        at += len(p)
        ends.append(at)
        at += len(sep)
    return sep.join(parts), ends


@pytest.mark.parametrize("parts, sep", [
    (["ខ្ញុំទៅផ្សារ។", "គាត់មកវិញ។"], " "), (["ကျွန်တော်သွားမယ်။", "သူလာမယ်။"], " "), (["እኔ ወደ ቤት ሄድኩ።", "እሱ መጣ።"], " "), (["Ես գնացի տուն։", "Նա եկավ։"], " "),
    (["वह घर गया।", "वह लौटा॥"], " "), (["我们走了。", "他们来了！"], ""), (["བོད་ཡིག་ཡིན།", "དེ་རེད།"], " ")])
def test_marks_of_many_scripts(parts, sep):
    text, ends = joined(parts, sep)
    assert model([text]).ends(text) == ends


def unpunctuated(spark, starts, middles, finals, sep, stop, n=600):
    """F1 of boundaries in texts without marks, learned from texts with them."""
    import random

    rng = random.Random(5)
    one = lambda: [rng.choice(starts), *rng.choices(middles, k=rng.randint(4, 9)), rng.choice(finals)]
    marked = [(i, (" " if sep else "").join(sep.join(one()) + stop for _ in range(6))) for i in range(n)]
    plain, want = [], set()
    for i in range(20):
        text, ends = joined([sep.join(one()) for _ in range(40)], sep)
        plain.append((n + i, text))
        want |= {(n + i, e) for e in ends}
    out = S.sentences(spark.createDataFrame(marked + plain, "doc_id long, text string")).filter(f"doc_id >= {n}")
    got = {(r.doc_id, r.end_pos) for r in out.collect()}
    return 2 * len(got & want) / (len(got) + len(want))


def test_unpunctuated_texts(spark):
    assert unpunctuated(spark, ["the", "we", "our"], ["model", "reads", "long", "pages", "quickly", "of", "text"], ["again", "today", "there"], " ", ".") > 0.95
    assert unpunctuated(spark, list("我他这"), list("们天书看读大小山水"), list("了吧呢"), "", "。") > 0.95
    assert unpunctuated(spark, ["ខ្ញុំ", "គាត់"], ["ទៅ", "ផ្សារ", "មាន", "ធំ"], ["ហើយ", "ទេ"], "", "។") > 0.9


@pytest.mark.parametrize("line, yes", [("- 186 -", True), ("261 |", True), ("Page 4 of 46", True), ("p. 7", True), ("~21~", True), ("xiv", True), ("[ 9 ]", True), ("3/9", True), ("REMARK", False), ("0.5 | 0.7", False), ("5.", False), ("civil", False), ("y = 0.9 x   (27)", False)])
def test_page_numbers(line, yes):
    assert N.is_page_number(line) is yes


def test_scan_noise_is_found_and_repaired(spark):
    body = "the measured cohort was\nseparated by a cross-validation of the measured corpus. the separated cohort stayed"
    texts = [(1, str(i), 1, body) for i in range(30)]
    texts += [(1, "a", 1, "the separ-\nated cohort was mea5ured by cross-\nvalidation"), (1, "b", 1, "the cohort was\nAnnals of Quiet Methods 2011, 5(2)\nseparated\n- 12 -\nby a corpus"), (2, "c", None, "metric | cohort\nREMARK\nsepar- \nated | 5"), (1, "d", 2, None), (1, "e", 2, "")]
    papers = spark.createDataFrame([(1, "A title of the paper", "Ann Lee", "Annals of Quiet Methods")], "paper_id long, title string, authors string, journal string")
    f = N.survey(spark.createDataFrame(texts, "field int, rec_key string, paper_id long, text string").filter("text is not null"), papers)
    key = lambda df: {(r.field, r.rec_key) for r in df.collect()}
    assert key(f.splits) == {(1, "a"), (2, "c")}
    assert key(f.misread) == {(1, "a")}
    assert key(f.heads) == {(1, "b")} and key(f.pages) == {(1, "b")}
    assert N.repaired(texts[30][3], set(), {("cross", "validation")}, {"mea5ured": "measured"}, False) == "the separated cohort was measured by cross-validation"
    assert N.repaired(texts[32][3], set(), set(), {}, True) == "metric | cohort\nREMARK\nseparated | 5"


PROMPT = "The census of the northern coast was repeated in spring. Neither the boats nor the harbours had changed. The authors report a larger catch for each village."


@pytest.mark.parametrize("answer, defect", [
    (None, "empty"), ("", "empty"), ("N/A", "empty"), ("…", "empty"), ("(no summary)", "empty"),
    ("I'm sorry, but I cannot summarise this passage.", "refusal"), ("Désolé, je ne peux pas résumer ce passage.", "refusal"),
    (PROMPT + " As stated above.", "copy"), ("The authors report a larger catch and the harb", "truncated"), ("The authors report that neither the -", "truncated"),
    ("Avec la mesure, le groupe confirme la question ouverte selon le second passage des notes.", "wrong_language"), ("沿着海岸，检索模型稍微改变了较短的段落。", "wrong_language"),
    ("The authors cannot confirm that the catch changed in the village.", None), ("The authors report a larger catch for each village.", None),
])
def test_votes_name_the_defect(answer, defect):
    """Majority of the votes on pairs with known defects; the label model starts from these."""
    votes = dict(zip(D.DEFECTS, D.vote(PROMPT, answer)))
    said = {d: [x for x in v if x >= 0] for d, v in votes.items()}
    strong = [d for d in D.DEFECTS if said[d] and sum(said[d]) / len(said[d]) > 0.5]
    assert (strong[0] if strong else None) == defect


def test_label_model_separates_pairs_with_known_defects():
    """Noisy votes of three functions on 5,000 pairs of which 4 % are defective: the cutoff is right on almost all."""
    import random

    rng = random.Random(1)
    truth = [rng.random() < 0.04 for _ in range(5000)]
    rows = [tuple(int(rng.random() < (0.93 if t else 0.02)) if rng.random() < 0.9 else -1 for _ in range(4)) for t in truth]
    post = D.fit(Counter(rows))
    wrong = sum((post[r] >= 0.5) != t for r, t in zip(rows, truth))
    assert wrong < 25


def test_codes_round_trip():
    for v in ((-1, 0, 1), (1, 1, 1, 1), (0,)):
        assert D.decode(D.encode(v), len(v)) == v


def _misread(spark, texts):
    rows = [(1, str(i), None, t) for i, t in enumerate(texts)]
    papers = spark.createDataFrame([], "paper_id long, title string, authors string, journal string")
    found = N.survey(spark.createDataFrame(rows, "field int, rec_key string, paper_id long, text string"), papers).misread
    return {(int(r.rec_key), r.word, r.meant) for r in found.collect()}


def test_copies_do_not_hide_a_misread_word(spark):
    texts = [f"The record number{i} is preserved" for i in range(60)] + ["The other record is prcserved here"] * 30
    assert _misread(spark, texts) == {(i, "prcserved", "preserved") for i in range(60, 90)}


def test_a_common_misread_word_is_judged_by_its_correction(spark):
    texts = [f"The record number{i} is preserved" for i in range(400)] + [f"The other number{i} is prcserved here" for i in range(10)]
    assert _misread(spark, texts) == {(i, "prcserved", "preserved") for i in range(400, 410)}


def _survey(spark, texts, papers=()):
    rows = [(1, str(i), None, t) for i, t in enumerate(texts)]
    p = spark.createDataFrame(list(papers), "paper_id long, title string, authors string, journal string")
    return N.survey(spark.createDataFrame(rows, "field int, rec_key string, paper_id long, text string"), p)


def test_heads_in_normal_case_at_the_edges_of_pages(spark):
    """A line that breaks a sentence at the edge of a text counts by its repetition in different texts; a heading before a sentence doesn't."""
    head = "Proceedings of the Baltic Workshop"
    body = "and the number{} of the record was counted again by the\nobservers of the northern station in the following spring"
    texts = [head + "\n" + body.format(i) for i in range(5)] + ["Introduction\nThe number{} of the record was counted again by all of the\nobservers of the station.".format(i) for i in range(5)]
    texts += ["Proceedings of the Baltic Workshp\n" + body.format(77), "Single line of its own here\n" + body.format(78)]
    texts += ["The record number{} was counted by all of the northern\n12\nJournal of Quiet Methods\nobservers of the station in the following spring again.".format(i) for i in range(3)]
    f = _survey(spark, texts)
    assert {int(r.rec_key) for r in f.heads.collect()} == {0, 1, 2, 3, 4, 10, 12, 13, 14}
    assert {r.line for r in f.heads.filter("rec_key in ('12', '13', '14')").collect()} == {2}


def test_confusions_are_learnt_from_the_corpus(spark):
    """A scanner that reads h as b is found out by its rare words, whatever the table starts with."""
    words = ["there", "other", "whole", "shore", "harbour", "thought", "higher", "rhythm", "method", "archive"]
    texts = [f"{' '.join(words)} in record {i}" for i in range(40)] + [f"the {w.replace('h', 'b', 1)} of item {i}" for i, w in enumerate(words)]
    v = spark.createDataFrame([(w, 40) for w in words] + [(w.replace("h", "b", 1), 1) for w in words] + [("otherx", 1), ("shoxe", 1), ("archivo", 1)], "word string, n long")
    assert N.learnt_confusions(v) == (("b", "h"),)
    got = {(int(r.rec_key), r.meant) for r in _survey(spark, texts).misread.collect()}
    assert got == {(40 + i, w) for i, w in enumerate(words)}


def test_misreadings_of_long_words():
    assert "x" * 60 + "e" in N.misreadings("x" * 60 + "c") and N.misreadings("") == []


def _scored(spark, pairs):
    df = spark.createDataFrame([("paragraph", i, p, a) for i, (p, a, _) in enumerate(pairs)], "kind string, rec_id long, prompt string, answer string")
    return df, D.posteriors(df).collect()


def test_cutoffs_are_the_best_on_held_out_pairs(spark):
    """Each cutoff lies where the F1 on labelled pairs is largest, and that is high."""
    from pair_fixture import pairs

    labelled = pairs(2500, 11)
    df, rows = _scored(spark, labelled)
    for d in D.DEFECTS:
        scored = [(r.posterior, labelled[r.rec_id][2] == d) for r in rows if r.defect == d]
        hit = lambda c: sum(t for p, t in scored if p >= c)
        f1 = lambda c: 2 * hit(c) / (sum(p >= c for p, _ in scored) + sum(t for _, t in scored))
        assert f1(D.CUTOFFS[d]) >= f1(D.best_cutoff(scored)[0]) - 0.03 and f1(D.CUTOFFS[d]) >= 0.9, d
    one = {r.rec_id: r.defect for r in D.one_label(D.labelled(df)).collect()}
    right = sum(one.get(i) == d for i, (_, _, d) in enumerate(labelled))
    assert right >= 0.99 * len(labelled)


def test_languages_that_no_list_knows(spark):
    """Dutch, Italian and Swedish answers to prompts in other languages, by n-grams learnt from the prompts."""
    from pair_fixture import pairs

    mixed = pairs(2000, 5, ("nl", "it", "sv"))
    df = spark.createDataFrame([("paragraph", i, p, a) for i, (p, a, _) in enumerate(mixed)], "kind string, rec_id long, prompt string, answer string")
    said = {r.rec_id: D.decode(r.wrong_language, 4)[3] for r in D.votes(df).collect()}
    wrong = [said[i] for i, (_, _, d) in enumerate(mixed) if d == "wrong_language"]
    fine = [said[i] for i, (_, _, d) in enumerate(mixed) if d is None]
    assert wrong.count(1) >= 0.95 * len(wrong) and fine.count(1) <= 0.01 * len(fine)


def test_han_and_kana_are_told_apart():
    zh, ja = "检索模型稍微改变了较短的段落并且保留了全部的表格和标题。", "この論文では段落の要約と表の構造を比較して結果をまとめています。"
    assert D.script(zh) == "han" and D.script(ja) == "kana" and D.language_of(zh) == "han"
    assert D.vote(zh * 3, ja)[4][2] == 1 and D.vote(zh * 3, zh)[4][2] == 0


def test_best_cutoff():
    assert D.best_cutoff([(0.1, False), (0.4, False), (0.8, True), (0.9, True)]) == (pytest.approx(0.6), 0.4, 0.8)
