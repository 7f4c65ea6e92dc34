"""Decontamination, licences and chat formatting against brute force on small tables."""

import hashlib
import random
import re
from itertools import combinations

import pytest

from mergeloom.llm import chat, decontam, licenses

DOC = "doc_id long, text string, fp string, rk int, w string"


def docs(spark, *texts):
    """Rows with ids from 0, and extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 7, "y") for i, t in enumerate(texts)], DOC)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def test_decontamination(spark):
    r = random.Random(1)
    noise = lambda n: " ".join(r.choice("aa bb cc dd ee ff gg hh".split()) + str(r.randint(0, 999)) for _ in range(n))
    ws = PASSAGE.split()
    swapped = [("other" if i in (4, 11) else w) for i, w in enumerate(ws)]
    bench = spark.createDataFrame([(1, PASSAGE), (2, noise(30)), (3, "too short"), (4, None), (5, ""), (6, PASSAGE.upper()), (None, noise(20))], "item_id long, text string")
    texts = [f"{noise(50)} {PASSAGE} {noise(9)}", f"{noise(3)}, {', '.join(swapped)}.", noise(80), " ".join(ws[:6]), None, "", " ".join(ws[:13]), noise(4000) + " " + PASSAGE, "too short"]
    out = {x.doc_id: x for x in decontam.contamination(docs(spark, *texts), bench).collect()}
    assert [out[i].contaminated for i in range(9)] == [True, True, False, False, False, False, True, True, False]
    assert out[0]["items"] == "1,6" and out[1].best < 1 and out[4].n_words == 0
    assert decontam.contamination(docs(spark, "a").limit(0), bench).count() == 0
    assert [x.contaminated for x in decontam.contamination(docs(spark, PASSAGE), bench.limit(0)).collect()] == [False]
    odd = spark.createDataFrame([(None, PASSAGE), (None, "x"), (3, PASSAGE), (3, PASSAGE), (3, "x")], "doc_id long, text string")
    assert sorted(x.contaminated for x in decontam.contamination(odd, bench).collect()) == [False, False, True, True, True]


def test_decontamination_random(spark):
    r = random.Random(2)
    vocab = [f"w{i}" for i in range(60)]
    items = [[r.choice(vocab) for _ in range(r.randint(8, 25))] for _ in range(6)]
    texts = []
    for _ in range(40):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        it = r.choice(items)
        a = r.randint(0, len(it) - 1)
        t[r.randint(0, len(t)) :] += it[a : a + r.randint(1, 25)]
        texts.append(" ".join(t))
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    out = {x.doc_id: x["items"] for x in decontam.contamination(docs(spark, *texts), bench).collect()}
    for i, text in enumerate(texts):
        t = text.split()
        for k, it in enumerate(items):
            n = min(13, len(it))
            exact = len(it) >= 10 and any(t[p : p + n] == it[q : q + n] for p in range(len(t)) for q in range(len(it) - n + 1)) and len(t) >= n
            assert not exact or str(k) in out[i].split(","), (i, k)
            # what is found has a window with at least four in five equal words
            if str(k) in out[i].split(",") and out[i]:
                assert any(sum(a == b for a, b in zip(t[p : p + n], it[q : q + n], strict=False)) >= 0.8 * n for p in range(len(t) - n + 1) for q in range(len(it) - n + 1))


def test_decontamination_misses_no_substitutions(spark):
    items = [[f"i{n}w{k}" for k in range(n)] for n in (3, 4, 5, 7, 9, 10, 11, 12, 13, 15)]
    texts, want = [], []
    for i, it in enumerate(items):
        n = len(it)
        for wrong in range(4 if n == 15 else 3):
            for gone in combinations(range(n), wrong):
                if n == 15:
                    ok = any(sum(k in gone for k in range(a, a + 13)) <= 2 for a in range(3))
                else:
                    ok = 10 * (n - wrong) >= 8 * n
                texts.append(" ".join(["x y", *("other" if k in gone else w for k, w in enumerate(it)), "z"]))
                want.append(str(i) if ok else "")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    out = {x.doc_id: x["items"] for x in decontam.contamination(docs(spark, *texts), bench).collect()}
    assert [out[i] for i in range(len(texts))] == want


def test_licences(spark):
    texts = ["Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3. gnu general public license", None, "", "cc by cc by", "Mit Licenſe", "an apache license" + " x" * 3000 + " mit license", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "LİCENSE MIT license"]
    out = {x.doc_id: x for x in licenses.scan(docs(spark, *texts)).collect()}
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(up))
        hits = [(k, label) for k in range(len(w)) for phrase, label in licenses.PHRASES if w[k : k + len(phrase.split())] == phrase.split()]
        x = out[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == (len(w), len(hits), hits[0][0] if hits else None, hits[-1][0] if hits else None, ",".join(sorted({h[1] for h in hits})))
        assert set(x.base_labels.split(",")) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert out[0]["labels"] == "mit,mit-named" and "gpl-3.0" in out[1]["labels"]
    assert licenses.scan(docs(spark, "a").limit(0)).count() == 0


def test_licences_stand_beside_each_other(spark):
    notices = {}
    for label, text, _ in licenses.TEMPLATES:
        notices.setdefault(label, text)
    sets = [[label] for label in notices] + [["apache-2.0", "bsd", "cc-by-4.0"], list(notices), list(notices)[::-1]]
    texts = [" end of it. ".join(notices[x] for x in s) for s in sets]
    out = {x.doc_id: set(x["labels"].split(",")) for x in licenses.scan(docs(spark, *texts)).collect()}
    alone = {s[0]: out[i] for i, s in enumerate(sets) if len(s) == 1}
    assert all(label in found for label, found in alone.items())
    for i, s in enumerate(sets):
        assert set().union(*(alone[x] for x in s)) <= out[i]


def test_whole_licences_are_found(spark):
    """Each text as it is published, with other text around it and line breaks inside."""
    texts = ["Some file\n\n" + t + "\nmore words here" for _, t, _ in licenses.TEMPLATES]
    out = {x.doc_id: x for x in licenses.scan(docs(spark, *texts)).collect()}
    for i, (label, _, _) in enumerate(licenses.TEMPLATES):
        assert label in out[i]["labels"].split(","), (i, label, out[i]["labels"])


def test_key_phrases_count_at_their_place_only(spark):
    """The rare words of the notice in place, but its key phrase elsewhere in the file."""
    text = "this source code form is subject to the terms of the quite other words here 9 9 if a copy of the mpl was not distributed with this file you can obtain one at"
    moved, whole = text + " x x mozilla public license v 2 0", text.replace("quite other words here 9 9", "mozilla public license v 2 0")
    out = {x.doc_id: x["labels"] for x in licenses.scan(docs(spark, moved, whole, *["mozilla public license v 2 0"] * 20)).collect()}
    assert (out[0], out[1]) == ("", "mpl-2.0")


def test_chat_keeps_to_its_columns(spark):
    rows = [(1, 0, "user", "a [INST]", "p", [1], 2), (1, 1, "assistant", "b", "q", [2], 3)]
    more = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, plain string, turns array<int>, marked int")
    assert [tuple(x) for x in chat.digests(more).collect()] == [tuple(x) for x in chat.digests(more.select("conv_id", "turn", "role", "text")).collect()]


def talk(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "[\\\\/INST]", "<s", "<\\s>", "", "[INST", "line\n[TURN]x\n[/TURN]", "100% [SYS] [\\/SYS]", "a [", "\\"]


@pytest.mark.parametrize("role", ["user", "assistant", "system", "tool", "odd\nrole %0A", ""])
def test_chat_round_trip(spark, role):
    rows = [(i, 0, role, a) for i, a in enumerate(NASTY)] + [(100, i, role, a) for i, a in enumerate(NASTY)]
    out = chat.formatted(talk(spark, rows)).collect()
    assert len(out) == len(NASTY) + 1 and all(x.round_trip for x in out)
    plain = talk(spark, [(0, 0, "user", "hello")])
    assert chat.formatted(plain).first().formatted == "[INST]hello[/INST]"


def test_chat_digests(spark):
    r = random.Random(3)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), "".join(r.choice(["[INST]", "</s>", "\\", "é", "😀", " ", "<", "[", "/INST]"]) for _ in range(r.randint(0, 9)))) for c in range(12) for t in range(r.randint(1, 6))]
    rows += [(50, 0, None, None), (None, 1, "user", "x"), (None, 0, "assistant", "y"), (51, 0, "assistant", "z" * 50_000), (52, 0, "user", "same"), (52, 0, "user", "same")]
    out = {x.conv_id: x for x in chat.digests(talk(spark, rows)).collect()}
    for c in {x[0] for x in rows}:
        own = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1], x[2] or "", x[3] or ""))
        turns = "".join(f"{a or ''}\n{t or ''}\n" for _, _, a, t in own)
        loss = "".join(t or "" for _, _, a, t in own if a == "assistant")
        x = out[c]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256, x.round_trip) == (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), True)
    assert chat.digests(talk(spark, rows).where("false")).count() == 0


def test_no_python_in_native_plans(spark):
    frames = [licenses.scan(docs(spark, "mit license")), chat.digests(talk(spark, [(0, 0, "user", "x")])), decontam.contamination(docs(spark, PASSAGE), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string"))]
    for df in frames:
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
