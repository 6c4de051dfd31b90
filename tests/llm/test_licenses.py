import math
import random
import re

from leafloom.llm.licenses import AGREE, BASE, COMMON, RARE, TEMPLATES, hits, proposed, scan


def run(docs):
    found = hits(docs)
    return [r.asDict() for r in found.select("row", "doc_id", "n_words").join(scan(found), "row", "left").collect()]


def places(text):
    """Brute force: the base phrases' places by words."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(i, label) for phrase, label in BASE.items() for p in [phrase.split()] for i in range(len(words)) if words[i : i + len(p)] == p]
    return len(words), at


def test_base_places_as_by_brute_force(spark, odd_docs):
    more = spark.createDataFrame(
        [(20, "MIT License. mit-license! MIT licensed"), (21, "mit license mit license"), (22, "GNU General Public\n\nLicense"), (23, "general public general public license"), (24, "apache licence"), (25, "mit K license"), (26, "license mit")],
        "doc_id long, text string",
    )
    docs = odd_docs.select("doc_id", "text").union(more)
    texts = sorted((str(r["doc_id"]), places(r["text"])) for r in docs.collect())
    want = sorted((k, n, len(at), min((i for i, _ in at), default=None), max((i for i, _ in at), default=None), ",".join(sorted({x for _, x in at}))) for k, (n, at) in texts)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_base"] or 0, r["first_word"], r["last_word"], r["base_labels"] or "") for r in run(docs))
    assert [tuple(map(str, x)) for x in got] == [tuple(map(str, x)) for x in want]


def test_labels_need_their_key_phrases(spark):
    docs = spark.createDataFrame(
        [(1, "Licensed under the Apache License, Version 2.0."), (2, "Licensed under CC BY-NC 4.0."), (3, "Licensed under CC BY 4.0"), (4, "under the apache license version 3"), (5, "This work is licensed under the GNU General Public License, version 3."), (6, "version 3 of the license, general public")],
        "doc_id long, text string",
    )
    got = {r["doc_id"]: (r["labels"] or "", r["score"]) for r in run(docs)}
    assert got[1][0] == "apache,apache-2.0" and got[1][1] == 1.0
    assert got[2][0] == "cc-by-nc-4.0" and got[3][0] == "cc-by-4.0"
    assert got[4][0] == "apache"
    assert got[5][0] == "gpl,gpl-3.0"
    assert got[6][0] == ""


def test_files_that_open_with_the_name_of_their_license(spark):
    names = {
        "GNU General Public License Version 3": "gpl,gpl-3.0", "Apache License Version 2.0": "apache,apache-2.0", "MIT License": "mit", "CC BY 4.0": "cc-by-4.0", "CC BY-NC 4.0": "cc-by-nc-4.0",
        "CC BY-SA 4.0": "cc-by-sa-4.0", "Lesser General Public License version 3": "gpl,lgpl-3.0", "Mozilla Public License v. 2.0": "mpl-2.0",
    }
    rows = [(f"{before}{name} some words of the file", label) for name, label in names.items() for before in ("", "here now come many words which are not any part of it then ")]
    got = {r["doc_id"]: r for r in run(spark.createDataFrame([(i, text) for i, (text, _) in enumerate(rows)], "doc_id long, text string"))}
    for i, (text, label) in enumerate(rows):
        assert (text, got[i]["labels"]) == (text, label)
        assert 0 < got[i]["score"] <= 1
    for i in range(0, len(rows), 2):
        assert got[i]["score"] == got[i + 1]["score"]
        assert got[i]["first_word"] in (None, got[i + 1]["first_word"] - 13 if got[i]["first_word"] is not None else None)


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def every_start(texts):
    """Labels and score of each text, trying every template at every start, before the text too."""
    kinds = [(label, text.split(), [text.split()]) for text, label in BASE.items()] + [(label, text.split(), [k.split() for k in keys]) for label, text, keys in TEMPLATES]
    split = [words_of(t) for t in texts]
    idf = lambda w: math.log((1 + len(texts)) / (1 + sum(w in x for x in split)))
    weight = {w: idf(w) for _, t, _ in kinds for w in t if w not in COMMON}
    out = []
    for words in split:
        labels, score = set(), 0.0
        for no, (label, t, keys) in enumerate(kinds):
            told = [p for p, w in enumerate(t) if w not in COMMON]
            rare = [p for p in sorted(told, key=lambda p: (-weight[t[p]], p)) if t[p] in words][:RARE]
            must = {i + k for key in keys for i in [next(i for i in range(len(t)) if t[i : i + len(key)] == key)] for k in range(len(key)) if t[i + k] not in COMMON}
            for start in range(-len(t), len(words)):
                stand = {p for p in told if 0 <= start + p < len(words) and words[start + p] == t[p]}
                if len(stand & set(rare)) >= AGREE and must <= stand:
                    labels.add(label)
                    if no >= len(BASE):
                        score = max(score, min(1.0, sum(weight[t[p]] for p in stand) / max(sum(weight[t[p]] for p in told), 1e-12)))
        out.append((",".join(sorted(labels)), score))
    return out


def test_labels_of_all_templates_as_by_trying_every_start(spark, prose):
    rng, texts = random.Random(6), []
    for i in range(160):
        parts = [prose(i, rng.randrange(8))]
        for _ in range(rng.randrange(3)):
            words = rng.choice([t for _, t, _ in TEMPLATES] + list(BASE)).split()
            if rng.random() < 0.5:  # a word lost, another one changed, or the beginning missing
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["other"], words[at : at + 1] * 2])
                words = words[rng.randrange(3) :]
            parts += [" ".join(words), prose(i + 500, rng.randrange(6))]
        texts.append(", ".join(parts))
    texts += [" ".join(t for _, t, _ in TEMPLATES), "mit license " * 30]
    got = {r["doc_id"]: (r["labels"] or "", r["score"] or 0.0) for r in run(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))}
    want = every_start(texts)
    for i, t in enumerate(texts):
        assert got[i][0] == want[i][0] and abs(got[i][1] - want[i][1]) < 1e-9, t
    assert {x for labels, _ in want for x in labels.split(",")} >= {label for label, _, _ in TEMPLATES}


def test_only_rare_words_are_looked_up(spark):
    """Starts come from the rarest words alone: common words of a template propose nothing."""
    found = hits(spark.createDataFrame([(1, "license software copy " * 200), (2, "the gnu affero license")], "doc_id long, text string"))
    rare = {0: [("affero", 1), ("gnu", 0), ("license", 2)], 1: [("copy", 2)]}
    assert [tuple(r)[1:] for r in proposed(found, rare).collect()] == [(0, 1)]


def test_empty_table(no_docs):
    assert run(no_docs) == []
