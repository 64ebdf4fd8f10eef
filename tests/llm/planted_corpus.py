"""A corpus with a planted case for each stage."""

import numpy as np

WORDS = "thor ere an the onha wh tion ed ea nt ble sh re he ou es st ing".split()


def prose(seed, n=80):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(WORDS, r.integers(1, 4))) for _ in range(n))


def corpus(spark, tmp_path):
    rows, labels = [], []
    for i in range(300):
        t = prose(i).split()
        if i % 6 == 0:
            t[10] = t[40] = t[60] = "scumling"
        rows.append((i, " ".join(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    item = prose(9999, 30)
    rows += [(300, prose(1000) + ' token = "' + "0f" * 20 + '"'), (301, prose(1)), (302, prose(2).replace(prose(2).split()[40], "changed", 1)), (303, prose(1001) + " " + item + " " + prose(1002)), (304, None)]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(7, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [i for i, _ in rows if i >= 300 or i % 6]
    no_copies = [i for i in clean if i not in (301, 302)]
    no_leaks = [i for i in no_copies if i != 303]
    return docs, {"toxicity": clean, "near_duplicates": no_copies, "decontamination": no_leaks, "secrets": no_leaks}
