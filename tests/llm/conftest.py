import json
import random
from datetime import datetime, timedelta

import pytest

ARTICLE = "article_id string, source_id string, canonical_url string, title string, published_at timestamp, content_hash string, retrieved_at timestamp, first_seen_at timestamp, payload string, text string, stamp int, key string, id string"
T0 = datetime(2026, 5, 1)


def payload(text):
    return json.dumps({"clean_text": text})


@pytest.fixture
def articles(spark):
    """Make an articles frame, with extra columns whose names clash with those inside the operators."""

    def make(rows):
        out = []
        for i, r in enumerate(rows):
            r = {"article_id": f"a{i:03}", "source_id": "s", "title": "", "retrieved_at": T0 + timedelta(hours=i)} | r
            p = r["payload"] if "payload" in r else payload(r.get("body"))
            out.append((r["article_id"], r["source_id"], r.get("url"), r["title"], T0, r.get("hash"), r["retrieved_at"], T0, p, "clash", i, "clash", "clash"))
        return spark.createDataFrame(out, ARTICLE)

    return make


@pytest.fixture
def texts():
    """Random texts and edited copies of them."""

    def make(n, words=60, edits=5, seed=1):
        rnd = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(300)]
        out = []
        for i in range(n):
            if i % 3 and out:
                w = rnd.choice(out).split()
                for _ in range(rnd.randrange(2 * edits)):
                    w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            else:
                w = rnd.choices(vocabulary, k=rnd.randrange(4, words))
            out.append(" ".join(w))
        return out

    return make
