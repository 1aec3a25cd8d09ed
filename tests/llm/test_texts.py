import random

import numpy as np
import pytest

from termloom.llm import mixing, passages, pieces
from termloom.llm.tokens import DEFAULT_TOKENIZER, encoder

WORDS = [
    f"{a}{b}{c}" for a in ("kor", "vil", "ta", "émo", "strø") for b in ("la", "ni", "pu", "fa") for c in ("x", "n", "3")
]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def brute(doc, item, k=15):
    d, w = passages.word_runs(doc), passages.word_runs(item)
    have = {tuple(d[i : i + k]) for i in range(len(d) - k + 1)}
    return any(tuple(w[i : i + k]) in have for i in range(len(w) - k + 1))


def test_search_against_windows(table):
    rng = random.Random(2)
    items = [(i, text(rng, rng.choice([10, 15, 40]))) for i in range(12)] + [(50, "a b c d e f g h i j k l m n o p q")]
    docs = []
    for d in range(80):
        parts = text(rng, 30).split()
        if d % 2:
            w = passages.word_runs(rng.choice(items)[1])
            at, n = rng.randrange(len(w)), rng.choice([13, 14, 15, 16, 30])
            parts[10:10] = w[at : at + n]
        docs.append((d, " ".join(parts)))
    docs += [(90, None), (91, ""), (92, "..."), (None, items[2][1]), (93, items[0][1] + " " + items[2][1])]
    got = passages.leaked_items(
        table("doc_id bigint, text string, item_id int", [(*d, 7) for d in docs]),
        table("item_id bigint, text string, doc_id int", [(*i, 8) for i in items] + [(None, "x", 1), (99, None, 1)]),
        item_chars=700
    )
    rows = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    want = {(d, i) for d, t in docs if d is not None and t for i, w in items if brute(t, w)}
    assert len(rows) == len(set(rows)) and set(rows) == want and want


def test_form_makes_no_difference_and_words_stay_whole(table):
    item = " ".join(f"wörd{i}ﬁx" for i in range(20))
    w = [f"wörd{i}fix" for i in range(20)]
    forms = {
        1: " ".join(w[2:17]).upper(),
        2: "--".join(w[2:17]),
        3: "wörd2fix, " + "  ".join(w[3:17]),
        4: " ".join(w[2:16]) + " wör-\nd16fix!",
        5: " ".join(x[:2] + "​­" + x[2:] for x in w[2:17]),
        6: "<p class='a'>" + " <b>".join(w[2:9]) + "</b>&nbsp;" + "&#32;".join(w[9:17]) + "</p>",
        7: " ".join("".join(chr(ord(c) + 0xFEE0) if "a" <= c <= "z" else c for c in x) for x in w[2:17]),
        8: " ".join(w[2:16]),
        9: "s" + " ".join(w[2:17]),
        10: " ".join(w[2:17]) + "s",
        11: " ".join(w[2:9] + ["no"] + w[9:17]),
        12: "_".join(w[2:17]),
    }
    got = passages.leaked_items(
        table("doc_id bigint, text string", list(forms.items()) + [(1, forms[8])]),
        table("item_id bigint, text string", [(5, item)])
    )
    assert {(r["doc_id"], r["words"]) for r in got.collect()} == {(d, 15) for d in (1, 2, 3, 4, 5, 6, 7, 12)}
    report = passages.leak_report(
        table("doc_id bigint, text string", forms.items()),
        table(
            "item_id bigint, text string, split string, kind string", [(5, item, "test", None), (6, "short", None, "x")]
        )
    ).collect()
    assert {(r["item_id"], r["documents"]) for r in report} == {(5, 8), (6, 0)}


def test_nothing_to_search(table):
    docs, items = table("doc_id bigint, text string", [(1, "a")]), table("item_id bigint, text string")
    assert passages.leaked_items(docs, items).count() == 0 and passages.leaked_items(docs.limit(0), items).count() == 0


LONG = {
    "prose": "The valve opens. It closes again; then the pump runs at 3.5 bar.\n\n" * 60,
    "claims": "".join(
        f"{i}. A device as claimed in claim {i - 1}, wherein the lid {i} is fixed.\n" for i in range(2, 70)
    ),
    "one word": "x" * 3000,
    "japanese": "弁は開く。ポンプが動く。" * 60,
    "no breaks": "棒" * 900,
    "emoji": "👩‍👩‍👧 " * 120,
    "short": "Nothing.",
    "empty": "",
}


@pytest.mark.parametrize(
    "name", ["byte_bpe_50k.tiktoken", "piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"]
)
def test_pieces_hold_the_whole_text(name):
    enc, limit, overlap = encoder("/opt/tokenizers/" + name), 200, 16
    for kind, text_ in LONG.items():
        starts = enc.starts(text_)
        rows = pieces.cut(text_, enc, limit, overlap)
        if len(starts) <= limit:
            assert rows == []
            continue
        assert rows[0][1] == rows[0][3] == 0 and rows[-1][4] == len(text_) and rows[-1][5] == "end"
        for a, b in zip(rows, rows[1:]):
            # the last tokens again, and on
            assert b[1] <= a[2] and a[2] - b[1] >= overlap and a[2] - b[1] <= overlap + 8 and b[2] > a[2]
        for r in rows:
            assert len(enc.ids(text_[r[3] : r[4]])) <= limit, (kind, r)
    assert {r[5] for r in pieces.cut(LONG["claims"], enc, limit, overlap)} == {"claim", "end"}
    assert (
        "hard" in {r[5] for r in pieces.cut(LONG["one word"], enc, limit, overlap)}
        or len(enc.starts(LONG["one word"])) <= limit
    )


def test_long_pieces(table):
    rows = (
        [(i, t, 1) for i, t in enumerate(LONG.values())] + [(None, "y" * 9000, 1), (40, None, 1), (0, LONG["prose"], 2)]
    )
    out = pieces.long_pieces(table("doc_id bigint, text string, piece int", rows), 200, 16).collect()
    enc = encoder(DEFAULT_TOKENIZER)
    assert {r["doc_id"] for r in out} == {i for i, t in enumerate(LONG.values()) if len(enc.ids(t)) > 200}
    assert all(r["text"] == list(LONG.values())[r["doc_id"]][r["char_start"] : r["char_end"]] for r in out)
    assert pieces.long_pieces(table("doc_id bigint, text string")).count() == 0


def _docs(n=240):
    rng = random.Random(8)
    own = {
        "a": ["alpha beta gamma", "beta gamma"], "b": ["one two three", "three two"], "c": ["rot grün blau", "blau rot"]
    }
    return [
        (i, " ".join(rng.choice(own[s]) for _ in range(rng.randrange(1, 60))), {"a": " A", "b": "b", "c": "C "}[s])
        for i in range(n)
        for s in [rng.choice("aaaabbc")]
    ]


def test_mix_meets_its_targets_where_it_can(table):
    docs = (
        _docs()
        + [(900, None, "a"), (901, "", "b"), (902, "alpha beta gamma " * 20, None), (903, "one two " * 9, "unheard of")]
    )
    mix = mixing.mix_sources(
        table("doc_id bigint, text string, source string, label int, tokens int", [(*d, 0, 0) for d in docs]),
        table(
            "source string, target_share double, max_repeats int",
            [("a", 0.3, 2), ("b", 0.3, 3), ("C", 0.3, 1), ("none-such", 0.1, 5)]
        ),
        size=64
    )
    enc = encoder(DEFAULT_TOKENIZER)
    size = sum(len(enc.ids(t)) for _, t, _ in docs if t)
    report = {r["source"]: r for r in mix.report().collect()}
    for s, share in (("a", 0.3), ("b", 0.3)):
        assert abs(report[s]["mix_tokens"] - share * size) < 1e-3 * size and not report[s]["below_target"]
    assert (
        report["C"]["below_target"] and report["none-such"]["below_target"] and report["none-such"]["mix_tokens"] == 0
    )
    own = sum(len(enc.ids(t)) for _, t, s in docs if t and s == "C ")
    # a little of the unlabelled
    assert report["C"]["most_tokens"] == report["C"]["tokens"] == own and 0 <= report["C"]["mix_tokens"] - own < 5
    assert mix.converged and len(mix.steps) < 20
    for s in ("a", "b"):  # whole copies hold the shares too
        assert abs(report[s]["actual_share"] * size - report[s]["mix_tokens"]) < 0.03 * size
    used = mix.documents().collect()
    assert sum(r["tokens"] * r["copies"] for r in used if r["source"] == "a") == report["a"]["copied_tokens"]
    cap = {"a": 2, "b": 3, "C": 1, None: 5}
    assert (
        len(used) == len(docs)
        and all(0 <= r["rate"] <= cap[r["source"]] + 1e-9 and abs(r["copies"] - r["rate"]) < 1 for r in used)
    )
    assert any(r["rate"] > 1 for r in used)


def test_memberships_stay_soft_and_whole():
    q = mixing._memberships(np.array([0, 1, -1]), np.array([[0.9, 0.1], [1.0, 0.0], [0.7, 0.3]], np.float32))
    assert q.sum(axis=1).tolist() == [mixing.UNIT] * 3 and q[2].tolist() == [700, 300]
    assert q[0][0] >= 999 and 0 < q[1][0] < 0.2 * mixing.UNIT  # a label outweighs a text that speaks against it


def test_classifier_knows_held_out_documents(table):
    docs = [(i, t, "abc".index(s.strip().lower())) for i, t, s in _docs(300)]
    w, b = mixing.fit_classifier(table("doc_id bigint, text string, label int", docs[:200]), 3, size=64)
    enc = encoder(DEFAULT_TOKENIZER)
    good = [int(np.argmax(w @ mixing._features(enc.ids(t), 64) + b)) == k for _, t, k in docs[200:]]
    assert sum(good) >= 0.9 * len(good)


@pytest.mark.parametrize("docs", [[], [(1, "only one", "a")], [(1, None, None)]])
def test_small_mixes(table, docs):
    targets = [("a", 1.0, 1), (None, 0.5, 1), ("b", None, None)]
    mix = mixing.mix_sources(
        table("doc_id bigint, text string, source string", docs),
        table("source string, target_share double, max_repeats int", targets),
        size=64
    )
    assert mix.report().count() == 2 and mix.documents().count() == len(docs)
    none = mixing.mix_sources(
        table("doc_id bigint, text string, source string", docs),
        table("source string, target_share double, max_repeats int"),
        size=64
    )
    assert none.report().count() == 0 and [r["copies"] for r in none.documents().collect()] == [0] * len(docs)
