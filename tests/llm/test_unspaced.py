"""Toxicity of texts without spaces: what stands late in a run counts."""

import random

import numpy as np
import pytest

from cairnfield.llm import toxicity


def bag(text):
    indptr, buckets, counts = toxicity.features([text], 16)
    return dict(zip(buckets.tolist(), counts.tolist(), strict=True))


@pytest.mark.parametrize(("filler", "phrase"), [("天地玄黄宇宙洪荒" * 10, "恶毒言语"), ("กขคงจฉชซ" * 10, "ฮฬหส"), ("abcdefgh" * 10, "vilenasty"), ("天地，玄黄。" * 20, "恶毒")])
def test_late_phrase_has_features(filler, phrase):
    assert bag(filler + phrase + filler) != bag(filler + filler)
    own = set(bag(filler + phrase + filler)) - set(bag(filler))
    assert own & set(bag("龙" * 30 + phrase + "q" * 60)) or filler.isascii()


def test_spaced_words_have_no_more_features_than_before():
    assert len(bag("plain words über café")) == 8


def test_a_run_cut_into_parts_keeps_all_ngrams():
    text = "天地玄黄宇宙洪荒日月盈昃辰宿列张" * 12
    data = np.frombuffer(text.encode(), np.uint8)
    fold = toxicity._LETTER[data]
    want = sum(len(x) for x in toxicity._grams(data, fold, np.array([0]), np.array([len(data)]), 16)[0])
    old, toxicity.BLOCK = toxicity.BLOCK, 100
    try:
        got = bag(text)
    finally:
        toxicity.BLOCK = old
    whole = bag(text)
    grams = {int(b) for x in toxicity._grams(data, fold, np.array([0]), np.array([len(data)]), 16)[1] for b in x}
    assert all(got[b] >= whole[b] for b in grams) and want == sum(len(text) - n + 1 for n in toxicity.GRAMS)


def test_learns_a_phrase_late_in_unspaced_texts(spark):
    rng = random.Random(5)
    signs = [chr(0x4E00 + 2 * k) + chr(0x5E00 + k) for k in range(30)]
    docs, labels = [], []
    for i in range(400):
        t = rng.choices(signs, k=rng.randint(40, 60))
        toxic = i % 4 == 0
        for _ in range(4 * toxic):
            t.insert(rng.randint(20, len(t)), "龍虎豹狼")
        docs.append((i, "".join(t)))
        labels.append((i, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    model = toxicity.train(d, spark.createDataFrame(labels[:200], "doc_id long, toxic int"), 200, 400)
    score = {r.doc_id: r.score for r in toxicity.score(spark, d, model, keep=("doc_id",)).filter("doc_id >= 200").collect()}
    pos, neg = [s for i, s in score.items() if i % 4 == 0], [s for i, s in score.items() if i % 4]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.97
