import re

from strandwise.llm import licenses

SCHEMA = "doc_id long, text string, license string, gram int"


def brute(rows, t=0.8):
    out = set()
    for i, text in rows:
        if i is None:
            continue
        units = [("line", n, x) for n, x in enumerate((text or "").split("\n"))] + [("text", -1, text or "")]
        for scope, n, unit in units:
            words = re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), unit))
            own = {f"{a} {b}" for a, b in zip(words, words[1:])}
            best = (0, 1 - 1000, "")
            for k, name, s, template in licenses.template_rows():
                grams = set(licenses.template_bigrams(template))
                if s == scope:
                    best = max(best, (2 * len(own & grams) / (len(own) + len(grams)), -k, name))
            if best[0] >= t:
                out.add((i, n, scope, best[2], round(best[0], 9)))
        inside = []
        for k, name, s, template in licenses.template_rows():
            n = len(licenses.template_words(template))
            if s == "text" and len(words) > n:
                grams, tried = set(licenses.template_bigrams(template)), []
                for start in {*range(0, len(words) - n + 1, max(1, n // 8)), len(words) - n}:
                    own = {f"{a} {b}" for a, b in zip(words[start : start + n - 1], words[start + 1 : start + n])}
                    tried.append((2 * len(own & grams) / (len(own) + len(grams)), -start))
                if max(tried)[0] >= t:
                    inside.append((max(tried)[0], -k, -max(tried)[1], n, name))
        for f in inside:
            if not any(g[:2] > f[:2] and g[2] < f[2] + f[3] and f[2] < g[2] + g[3] for g in inside):
                out.add((i, f[2], "window", f[4], round(f[0], 9)))
    return out


def test_against_brute_force(spark):
    mit = licenses.TEXTS["mit"]
    rows = [
        (1, "some prose\nReleased under the MIT License.\nmore"), (2, mit.replace("\n", " ")), (3, mit + " with a few words more than there are"),
        (4, "x " + mit * 3), (5, None), (6, ""), (7, "\n\n"), (8, "LICENSED under the  Apache License - version 2.0!"), (9, "under the License"),
        (None, "Released under the MIT License."), (10, "This work is licensed under the GNU General Public License, version 3."),
        (14, "\n".join(f"x_{i} = compute({i}) # line" for i in range(40)) + "\n/*\n * " + mit.replace("\n", "\n * ") + "\n */\n" + "return value of it " * 90),
        (15, "start " * 77 + licenses.TEXTS["bsd-3-clause"] + " middle" * 300 + licenses.TEXTS["apache-2.0"] + " end" * 13), (16, licenses.TEXTS["gpl-3.0"] + " and more" * 60),
        (17, "half of it: " + mit[: len(mit) // 2] + " word" * 500), (18, licenses.TEXTS["isc"].replace("\n", " ")),
        (11, "é " * 50_000 + "\nLicensed under CC BY-NC 4.0."), (12, "the the the the the the"), (13, "Released under the the MIT License"),
    ]
    got = licenses.scan(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)).collect()
    assert {(r.doc_id, r.line_no, r.scope, r.license, round(r.dice, 9)) for r in got} == brute(rows)
    assert {(r.doc_id, r.license) for r in got} >= {(1, "mit"), (2, "mit"), (3, "mit"), (8, "apache-2.0"), (10, "gpl-3.0"), (11, "cc-by-nc-4.0")}
    windows = {(r.doc_id, r.license) for r in got if r.scope == "window"}
    assert windows >= {(14, "mit"), (15, "bsd-3-clause"), (15, "apache-2.0"), (16, "gpl-3.0")} and not windows & {(15, "bsd-2-clause"), (17, "mit"), (16, "lgpl-3.0")}


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "Released under the MIT License.", "x", 1)]
    assert len(licenses.scan(spark.createDataFrame(rows * 3, SCHEMA)).collect()) == 1
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).collect() == []


def test_texts_under_one_id_are_scanned_apart(spark):
    mit = licenses.TEXTS["mit"].split()
    halves = [(1, " ".join(mit[: len(mit) // 2]) + " x" * 60, "x", 1), (1, " ".join(mit[len(mit) // 2 :]) + " y" * 60, "x", 1)]
    assert licenses.scan(spark.createDataFrame(halves, SCHEMA)).collect() == []


def test_main_path_is_native(spark):
    plan = licenses.scan(spark.createDataFrame([], SCHEMA))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
