"""Small hand-made receptor data."""

import random

from paratope.schema import CDR_COLUMNS, TRIAD_COLUMNS, TRIAD_WITH_CDR

AMINO = "ACDEFGHIKLMNPQRSTVWY"


def triads(spark, n, seed=0, antigens=6, cognate=True):
    rng = random.Random(seed)
    word = lambda k: "".join(rng.choice(AMINO) for _ in range(k))
    pool = [(f"PEPTIDE{'ACDEFG'[i % 6]}{i // 2}", "I", "heavy", "human", f"A*0{i}:01", "MHC" + "AC"[i % 2] * 3, "light", "human", "B2M", "LIGHT") for i in range(antigens)]
    loops = [[word(5) for _ in range(8)] for _ in range(4)]
    rows = []
    for i in range(n):
        antigen = rng.choice(pool)
        cdr = list(rng.choice(loops))
        for at in (3, 7):
            cdr[at] = "CASS" + word(rng.choice([3, 4, 6])) + "YEQYF"
        if rng.random() < 0.5:
            cdr = [rng.choice(loops)[j] if rng.random() < 0.2 else c for j, c in enumerate(cdr)]
        rows.append(("", cognate, *antigen, "alpha", "human", "A" + cdr[3], "beta", "human", "B" + cdr[7], *cdr))
    from paratope.functions.keys import with_job_name
    from paratope.schema import TRIAD_HASHED

    df = spark.createDataFrame(rows, TRIAD_WITH_CDR)
    return with_job_name(df, TRIAD_HASHED).select(*TRIAD_COLUMNS, *CDR_COLUMNS)
