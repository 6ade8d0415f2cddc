"""Property checks from the test strategy: section scores of chosen orders; set outputs partition their inputs."""

import random
import re

from pyspark.sql import functions as F

from rolefit.constants import SECTION_WEIGHTS
from rolefit.operators import sections as se
from rolefit.operators import skills as sk
from rolefit.plans.catalog import QUERIES
from tests.conftest import SF_SMALL


#: First-hit lines of skills, experience, education, certifications (0: none) and the score.
ORDERS = [((0, 0, 0, 0), 0), ((1, 0, 0, 0), 50), ((0, 1, 0, 0), 30), ((1, 2, 3, 4), 100), ((4, 3, 2, 1), 100), ((1, 2, 0, 0), 90),
          ((2, 1, 0, 0), 80), ((1, 1, 1, 1), 100), ((0, 1, 2, 3), 60), ((1, 0, 2, 3), 80), ((1, 2, 0, 3), 100), ((0, 0, 0, 2), 10),
          ((3, 0, 1, 0), 70), ((1, 3, 2, 0), 100)]


def test_section_scores(spark):
    names = [s for s, _ in SECTION_WEIGHTS]
    df = spark.createDataFrame([c for c, _ in ORDERS], ", ".join(f"{n} int" for n in names))
    score, _ = se.section_score_cols(F.struct(*[F.col(n) for n in names]))
    got = {tuple(r)[1:]: r.s for r in df.select(score.alias("s"), *names).collect()}
    assert got == dict(ORDERS)


def test_gap_sets_partition_jd_skills(spark):
    for r in QUERIES["skill_gap_arrays"](spark, SF_SMALL).collect():
        m, x, j = set(r.missing_skills), set(r.matched_skills), set(r.all_jd_skills)
        assert m | x == j and not (m & x)
        assert x <= set(r.all_resume_skills)
        assert list(r.missing_skills) == sorted(r.missing_skills)


#: Pieces of forms and texts: words, symbols, spaces at odd places.
PIECES = ["c", "c", "a", "ab", "net", "java", "é", "+", "+", "#", ".", "/", "-", " ", " ", " ", "  ", "\n", "_", "1"]


def test_phrase_join_equals_the_word_bounded_search(spark):
    rnd = random.Random(11)
    forms = sorted({"".join(rnd.choices(PIECES, k=rnd.randint(0, 6))) for _ in range(250)} | {"", " ", "c++", "c#", ".net", "a b c", " a", "a ", "++"})
    texts = ["".join(rnd.choices(PIECES, k=rnd.randint(0, 30))) for _ in range(120)] + ["", " ", "a b c", "a b a b c", "c++x", "asp.net"]
    db = spark.createDataFrame([(str(i), f"Skill{i}", [f], False) for i, f in enumerate(forms)],
                               "skill_id string, skill_name string, low_surface_forms array<string>, match_on_tokens boolean")
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.skill_name) for r in sk.extract_skills(docs, db, "doc_id").collect()}
    norm = [re.sub(r"\s+", " ", t.lower()).strip() for t in texts]
    want = {(i, f"Skill{k}") for i, t in enumerate(norm) for k, f in enumerate(forms) if re.search(r"\b" + re.escape(f) + r"\b", t)}
    assert len(want) > 500
    assert got == want
