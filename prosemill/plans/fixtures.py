"""Fixture texts, the same on both sides of a comparison: written for this repository, at ids below zero."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prosemill.operators.storage import spread

TEXTS: list[str] = [
    "We utilize the tool in order to facilitate commencement. It is a robust, seamless and pivotal realm. They delve into the tapestry.",
    "Studies show that this works. Experts say so too. I hope this helps! Certainly! As an AI language model, I cannot say.",
    "The report was written by Ana. The door is closed. It was even. The the list ends. There is a rule that people follow.",
    "# Getting Started With The New Tool\n\nText here.\n\n### Skipped level.\n\n# Second Top Heading\n\n# Second top heading\n\n- **Speed**: fast\n- **Cost**: low\n- **Reach**: wide\n- four\n- five\n",
    "See [here](target.md) and ![](pic.png). Visit https://example.com/a for more. [x](https://example.com/?utm_source=feed)\n\n[used]: https://example.com\n[lost]: https://example.org\n\nA [link][used] stays.",
    "Send 12345 items at 5 pm on 3/4/2024. It costs $5M; pay .5 more; wait... Between 5 - 6 items? The 3rd one is 5% of 20 MB. e.g. this, i.e. that, etc.",
    "The chairman and his or her salesman use the blacklist on the master/slave bus. Guys, that is crazy and lame. A hour and an user met. Click it.",
    "He said “yes”, she said “no”. It’s a pity — a real one — and a shame — for us. We think our team and we agree. Towards the end, look backwards.",
    "You can use it. The user should wait. You will see it. Please sign in, then log in. Do not stop. It is not done. API's and TLA mix with tla. THIS IS ALL CAPS.",
    "Pursuant to the rule, tenants shall pay herein. It is not uncommon. You are required to make a determination. Currently, the color or colour is above. I see my own.",
    "First, second, and third. Red, green, and blue. One, two, and three. It works, not quite well. It is speed rather than cost. Moreover, it stays. Furthermore, it ends.",
    "One. Two words. Three words here. A naïve café costs 5 €, doi:10.1/x and ISBN 123. Dr. Smith went. Mr. Jones met U.S. staff at 3.5 km. Ends well",
]


#: Texts with parts that are masked, and what masking leaves of them, written by hand: a middle dot stands for each byte that is blanked.
MASKED: list[tuple[str, str]] = [
    ("a `b` c", "a ··· c"), ("a ``b`` c", "a ····· c"), ("a `b c", "a `b c"), ("x <b>y</b> z", "x ···y···· z"), ("x < y > z", "x < y > z"), ("x <!-- y\nz --> t", "x ······\n····· t"), ("p {{ q }} r", "p ······· r"), ("`é` ï", "···· ï"),
    ("```\ncode\n```\nend", "···\n····\n···\nend"), ("```py\na\n````\nb", "·····\n·\n····\nb"), ("~~~\na\n```\nb\n~~~\nc", "···\n·\n···\n·\n···\nc"), ("```\nopen to the end\nstill", "···\n···············\n·····"),
    ("---\na: 1\n---\nbody", "···\n····\n···\nbody"), ("+++\na = 1\n+++\nbody", "···\n·····\n···\nbody"), ("body\n---\na\n---\n", "body\n---\na\n---\n"), ("a <i title='x y'>b", "a ···············b"), ("1 `a` <b>`c`</b> 2", "1 ··· ·········· 2"), ("no marks", "no marks"), ("", ""),
]


def masked_texts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, t) for i, (t, _) in enumerate(MASKED)], "doc_id long, text string")


def masked_sql() -> str:
    """Expected rows: the hand-written texts, with a blank for each dot, and all documents that hold no mark as they are."""
    quoted = lambda t: t.replace("'", "''")
    rows = ", ".join(f"({-1 - i}, '{quoted(a)}', '{quoted(b)}')" for i, (a, b) in enumerate(MASKED))
    return rf"SELECT doc_id, strlen(text) AS bytes, md5(replace(masked, '·', ' ')) AS masked_md5 FROM (VALUES {rows}) v(doc_id, text, masked) UNION ALL SELECT doc_id, strlen(coalesce(text, '')), md5(coalesce(text, '')) FROM documents WHERE NOT regexp_matches(coalesce(text, ''), '[`<]|^~~~|\n ?~~~|\{{\{{|^---|^\+\+\+')"


def fixtures(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(-1 - i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixtures and all documents (doc_id, text)."""
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(fixtures(spark)))


def corpus_sql() -> str:
    rows = ", ".join("({}, '{}')".format(-1 - i, t.replace("'", "''")) for i, t in enumerate(TEXTS))
    return f"SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {rows}) v(doc_id, text)"
