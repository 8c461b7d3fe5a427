import random
import re

import public_tokenizers
import pytest
import sentencepiece
from test_decontam import distance, plain
from test_shingles import plain_kept

import corpus_pipeline
from packwright.llm.decontam import EDIT_RATE
from packwright.llm.lines import MIN_SITES

SYLLABLES = {"xx": ["the", "and", "ing", "ou", "tion"], "yy": ["chä", "keit", "ung", "ßer", "lich"]}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rnd = random.Random(11)

    def say(lang, n):
        return " ".join("".join(rnd.choices(SYLLABLES[lang], k=rnd.randint(1, 3))) for _ in range(n))

    items = [say("xx", 20) for _ in range(4)] + ["tiny"]
    rows, n = [], 0
    for k in range(120):
        lang = "xx" if k % 3 else "yy"
        text = "\n".join(say(lang, rnd.randint(8, 20)) for _ in range(4))
        if k % 4 == 0:
            text = "Accept all cookies here\n" + text
        if k % 10 == 3:
            text += "\n" + say(lang, 3) + " " + items[k % 4].title() + "!"
        rows.append((n, text, lang, f"s{k % 7}", len(text)))
        n += 1
        if k % 9 == 0:
            rows.append((n, text, lang, f"s{(k + 1) % 7}", len(text)))
            n += 1
    banner = "Accept all cookies here\n"
    for k in range(3):  # most of the text is spread lines, yet its own words are others
        rows.append((n, banner * 4 + say("xx", 6 + k), "xx", f"s{k}", 99))
        n += 1
    words = say("xx", 90).split()
    for at in (None, 20, 60):  # copies with a word changed are further apart than three bits, but share most shingles
        rows.append((n, " ".join(w if i != at else "tion" for i, w in enumerate(words)), "xx", "s3", 9))
        n += 1
    rows += [(n, "123 456 !!", "xx", "s1", 10), (n + 1, None, None, None, None), (n + 2, "", "xx", "s0", 0), (None, say("xx", 30), "xx", "s2", 5)]
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items


def brute(rows, items):
    """The rows of the pipeline by plain loops; languages are those of the texts' only syllables."""
    docs = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    sites = {}
    for r in docs:
        for line in r[1].split("\n"):
            if line.strip(" ") and r[3] is not None:
                sites.setdefault(line.strip(" "), set()).add(r[3])
    spread = {x for x, s in sites.items() if len(s) >= MIN_SITES}
    cut = []
    for k, text, *rest in docs:
        parts = text.split("\n")
        left = [x for x in parts if x.strip(" ") not in spread]
        cut.append((k, "\n".join(left) if "".join(left).strip(" ") else text, *rest))
    cut.sort(key=lambda r: (r[0] is None, r[0] or 0))
    kept = [cut[i] for i in plain_kept([r[1] for r in cut])]
    budget = {i: min(int(len(plain(i)) * EDIT_RATE), (len(plain(i)) - 8) // 8) for i in items if len(plain(i)) >= 8}
    return [r for r in kept if not any(distance(plain(i), plain(r[1]))[0] <= k for i, k in budget.items())]


def test_run(spark, corpus):
    folder, rows, items = corpus
    want = brute(rows, items)
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, folder).collect()
    assert sorted((str(r.doc_id), list(r.ids), r.n_tokens, r.exact) for r in got) == sorted(
        (str(r[0]), lib.encode(r[1]), len(lib.encode(r[1])), True) for r in want)
    assert 60 < len(want) < 130


def test_stages(spark, corpus):
    folder, rows, _ = corpus
    assert [re.sub(" .*", "", n) for n, _ in corpus_pipeline.STAGES] == ["language", "line", "SimHash", "benchmark", "SentencePiece"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and 0 < out.count() <= len(rows)
        empty = stage(spark, docs.limit(0), folder)
        assert empty.columns == docs.columns and empty.count() == 0
