"""Problem 10: per-document text statistics and a Gaussian mixture over them.

Every document gets counts and shares. A Gaussian mixture is fitted to the standardised
statistics of all documents by expectation-maximization: each step is one pass that
leaves one row of sufficient statistics per component. The components start at
inspected examples and keep their class (prose, list, table or junk); a weak prior at
the start keeps a component in place where a small corpus has no such texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillscan.session import durable, spread

# Common words by language.
COMMON = {
    "en": "the a an of to and in is it that this for on with as be are was were by at from or not but if we you they he she i has have had its our their which who what when than then there no one can may will would so all some any do does before after into over still each more most only also until while how why about out up down between both other because these those them his her my your been",
    "de": "der die das den dem des ein eine einen einem einer und oder aber ist sind war waren wird wurde in im an am auf aus bei mit nach von vor zu zum zur für nicht auch noch nur schon so wie wenn dass weil als es sie er wir ich ihr man sich hat haben kein keine einmal niemand mehr sehr diese dieser dieses durch über",
    "es": "el la los las un una unos unas de del y o pero es son fue era en con por para sin sobre que se su sus lo le al no más muy ya como cuando donde este esta estos estas ese esa hay ha han porque entre todo todos casi mismo misma solo nadie antes desde",
    "tr": "ve bir bu şu o da de ki mi için ile ama fakat çok daha en gibi kadar olan olarak artık yani göre sonra önce hiç hiçbir her ne neden değil var yok kimse onu bunların aynı çoğu üzere eden yalnızca başka içinde içindeki olmadan farklı biri belli hatta ise diye ayrıca ilk son yeni tek kendi birlikte aşağı yukarı",
    "fr": "le la les un une des du de et ou mais est sont dans en au aux par pour sur avec sans que qui ne pas plus ce cette ces il elle nous vous ils se sa son ses été",
    "it": "il lo la i gli le un uno una di del della dei e o ma è sono in con per su da al alla che non più si come questo questa anche",
    "pt": "o a os as um uma de do da dos das e ou mas é são em no na com por para sem que não mais se como este esta foi ao",
    "nl": "de het een en of maar is zijn was in op met van voor naar door niet ook nog als dat die dit er aan om te wordt",
    "ru": "и в не на что он она оно они с как это по но из у за от так о же бы к для мы вы я его её их был была было были если или",
    "pl": "i w na z do nie się że to jest o jak po co za od przez dla ale czy był była są",
}
WORDS = frozenset(w.replace("ı", "i") for ws in COMMON.values() for w in ws.split())
# The most common short words, which only running sentences hold in number.
CORE = frozenset(
    "the a an of to and in is it for on as be are was by at or if der die das und ist ein eine in den von zu mit nicht el los las de que y es en un una con por se no ve bir bu da için ile ama çok biri göre değil le les et du des est dans une il che di non per o os um é não het en van dat niet и в не на что с я он".split()
)
WORD = re.compile(r"(?<!\w)[^\W\d_]+(?:['’][^\W\d_]+)?(?!\w)")
# the same words in a text of ASCII alone
PLAIN_WORD = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z]+(?:'[A-Za-z]+)?(?![A-Za-z0-9_])")
SPACES, DIGITS, LETTERS = (bytes(c for c in range(128) if f(chr(c))) for f in (str.isspace, str.isdigit, str.isalpha))
TOKEN = re.compile(r"\S+")
CAMEL = re.compile(r"[a-z][A-Z]")
SENTENCE_END = re.compile(r"[.!?…。！？؟।][\"'”’»)\]*_`]*(?=\s|$)|[。！？]")
CLOSING = re.compile(r"[.!?…。！？؟।:;,][\"'”’»)\]*_`]*$")
BULLET = re.compile(r"^\s*(?:[-*•+–▪◦]|\d+[.)]|[a-z][.)])\s+")
CODE = re.compile(r"[{}();=]{1}\s*$|^\s*(?:def|class|import|from|return|func|function|const|let|var|public|private|if|for|while|end|else|elif|package|#include|@\w+)\b|:=|=>|->|\+=|==|&&|\|\|")
MOJIBAKE = re.compile(r"[ÃÂÄÅ][-ÿŒœŠšŸŽžƒˆ˜–—‘’‚“”„†‡•…‰‹›€™]|â€|�")
WIDE = re.compile(r"[぀-ヿ㐀-鿿가-힯؀-ۿ֐-׿฀-๿ऀ-ॿ]")
STATS = ["common", "core", "prose_share", "ends", "symbols", "digits", "word_len", "long_tokens", "line_ends", "bullets", "code", "fresh", "mojibake", "identifiers", "squeeze", "words"]
OPEN = ["n_chars", "n_words", "mean_word_length", "symbol_ratio", "line_end_share", "common_share"]


def _lower(s: str) -> str:
    return s.lower().replace("i̇", "i").replace("ı", "i")


def _words(text: str) -> tuple[list[str], list[str]]:
    """The words of a text, as they stand and in lower case."""
    if text.isascii():
        words = PLAIN_WORD.findall(text)
        return words, [w.lower() for w in words]
    return WORD.findall(text), WORD.findall(_lower(text))


def _characters(text: str) -> tuple[int, int, int]:
    """How many characters aren't space, are digits, are letters."""
    if text.isascii():
        b = text.encode()
        n = len(b)
        return len(b.translate(None, SPACES)), n - len(b.translate(None, DIGITS)), n - len(b.translate(None, LETTERS))
    return len(text) - sum(map(str.isspace, text)), sum(map(str.isdigit, text)), sum(map(str.isalpha, text))


def _is_prose(chunk: str) -> bool:
    """A run of words that reads like a sentence: mostly words, enough of them common."""
    solid = sum(map(len, chunk.split()))
    plain = chunk.isascii()
    if not plain and WIDE.search(chunk):
        return len(WIDE.findall(chunk)) >= 0.5 * solid
    words, low = _words(chunk)
    if len(words) < 3:
        return False
    common = sum(w in WORDS for w in low)
    return sum(map(len, words)) >= 0.62 * solid and common >= max(1, 0.12 * len(words)) and (plain or not MOJIBAKE.search(chunk))


def measure(text: str) -> tuple[list[float], list[float]]:
    """(open statistics, statistics of the mixture) of a non-blank text, over the whole text."""
    words, low = _words(text)
    lines = [x for x in text.splitlines() if x.strip()] or [text]
    n, nw, nl = max(1, len(text)), max(1, len(words)), len(lines)
    solid, digits, letters = _characters(text)
    solid = max(1, solid)
    common = sum(w in WORDS for w in low)
    plain = sum(text.count(c) for c in ".,;:!?'\"()-’“”")
    symbols = max(0, solid - letters - digits - plain)
    tokens = TOKEN.findall(text)
    long_chars = sum(len(t) for t in tokens if len(t) > 30)
    names = sum(1 for t in tokens if "_" in t[1:-1] or "/" in t[1:-1] or not t.islower() and CAMEL.search(t))
    ends = len(SENTENCE_END.findall(text))
    closed = sum(bool(CLOSING.search(x.rstrip())) for x in lines)
    bullets = sum(bool(BULLET.match(x)) for x in lines)
    code = sum(bool(CODE.search(x)) for x in lines)
    # paragraphs: wrapped lines belong together, a bullet or a blank line starts anew
    runs: list[str] = []
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n")):
        part = ""
        for x in block.split("\n"):
            if BULLET.match(x) or CODE.search(x):
                if part:
                    runs.append(part)
                runs.append(BULLET.sub("", x))
                part = ""
            else:
                part = f"{part} {x}"
        runs.append(part)
    prose = sum(sum(map(len, s.split())) for r in runs for s in re.split(r"(?<=[.!?…])\s+", re.sub(r"[*_`>#|]+", " ", r)) if _is_prose(s))
    grams = list(zip(low, low[1:], low[2:])) if len(low) > 3 else [tuple(low)]
    fresh = len(set(grams)) / max(1, len(grams))
    squeeze = min(1.0, len(zlib.compress(text.encode("utf-8", "replace"), 1)) / max(60, len(text.encode("utf-8", "replace"))))
    mean = sum(map(len, words)) / nw
    seen = [n, len(words), round(mean if words else 0.0, 4), round(symbols / solid, 4), round(closed / nl, 4), round(common / nw if words else 0.0, 4)]
    mixed = [
        common / nw if words else 0.0, min(0.5, sum(w in CORE for w in low) / nw), min(1.0, prose / solid), min(0.3, ends / max(1, len(tokens))), min(0.5, symbols / solid), digits / solid, min(12.0, mean) / 12 if words else 0.0,
        long_chars / solid, closed / nl, bullets / nl, code / nl, fresh, min(0.3, len(MOJIBAKE.findall(text)) / n), names / max(1, len(tokens)), squeeze, min(1.0, len(words) / 200) ** 0.5,
    ]
    return [float(x) for x in seen], mixed


# Inspected examples: (class, group, text); a group starts one component.
_N = "\n"
EXAMPLES: list[tuple[str, str, str]] = [
    ("prose", "plain", "The second pass reads the whole table even though it needs one column. If you change the order of the calls, please tell the people who run the nightly job. It took us an hour to see why the result was empty, and we should fix it before the next release."),
    ("prose", "plain", "# Review of the parser\n\nMost of the time this helper works, but it fails when the input is missing. I would rather split it in two than add another flag.\n\nNobody remembers why the limit was set to 40, and the note in `load_rows` does not say."),
    ("prose", "plain", "In the morning the harbor was quiet, and the two of them walked along the wall without a word. She had read the letter twice. What it meant for the house, she could not say."),
    ("prose", "short", "The test for load_rows only covers the easy case."),
    ("prose", "short", "This import is called from 42 places and has no owner"),
    ("prose", "short", "Someone raised the limit to 80 without saying why."),
    ("prose", "caps", "THE SHARED STATE IS READ BY TWO THREADS AND WRITTEN BY A THIRD, SO THE RESULT DEPENDS ON THE ORDER IN WHICH THEY START. WE SHOULD FIX IT BEFORE THE NEXT RELEASE."),
    ("prose", "wrapped", "> As far as we can tell, this handler waits\n> for a lock that another thread may hold\n> for minutes, although the tests still pass.\n> Please read the note on locks before you\n> change this part of the code."),
    ("prose", "wrapped", "The old adapter was written before we had a\nqueue and still assumes there is none. A smaller\nchange would be to pass it in as an argument, so that\nthe two halves can be tested on their own."),
    ("prose", "marked", "A **nightly** task called `move_rows` moves *120* rows from `Alpha` towards _Beta_, but nobody tells **the** reader that the `copy` was *already* sealed at step **14**."),
    ("prose", "german", "Diese Datei ist so groß geworden, dass niemand sie mehr ganz versteht. Der Befund ist echt, aber weniger schwer, als er zuerst aussieht. Wir schlagen vor, die Prüfung in ein eigenes Modul zu legen."),
    ("prose", "turkish", "Bu dosya çok büyüdü ve artık tek bir kişi tarafından okunamıyor. Bu bulgu gerçek, fakat önemi ilk bakışta göründüğünden daha düşük. Bir sonraki sürümden önce bu bölümü sadeleştirmek gerekiyor."),
    ("prose", "turkish", "load_rows işlevi hatayı yakalıyor ama hiçbir yere yazmıyor."),
    ("prose", "spanish", "El hallazgo es real, pero es menos grave de lo que parece. La prueba de load_rows solo cubre el caso fácil, y nadie ha tocado esta parte desde la última revisión."),
    ("list", "numbered", _N.join(f"{k}) {v}_{w} {x}," for k, (v, w, x) in enumerate([("load", "row", "queue"), ("split", "cell", "panel"), ("merge", "page", "cursor"), ("check", "lock", "bridge"), ("trim", "log", "cache"), ("emit", "job", "ticket")] * 3, 1))),
    ("list", "numbered", _N.join(f"{k}. {v} {w};" for k, (v, w) in enumerate([("milk", "bread"), ("nails", "screws"), ("paper", "ink"), ("rope", "wire")] * 3, 1))),
    ("list", "paths", _N.join(f"{d}/{a}_{b}.{e}" for d, a, b, e in [("src/utils", "load", "row", "py"), ("lib", "split", "cell", "rb"), ("server", "merge", "page", "go"), ("web/pages", "check", "lock", "ts"), ("core", "trim", "log", "java")] * 3)),
    ("list", "paths", _N.join(f"* {d}/{a}_{b}.{e}" for d, a, b, e in [("src/utils", "load", "row", "py"), ("lib", "split", "cell", "rb"), ("server", "merge", "page", "go"), ("web/pages", "check", "lock", "ts")] * 3)),
    ("list", "keywords", "record, lazy bucket, panel, draft packet, snapshot, ledger, cursor, basket, depot, permit, courier, sensor, tariff, handle, planner, window, primary banner, strict record, thread, partial toast, signed shift, anchor, digest, gauge"),
    ("table", "delimited", "repo,files,score,grade\nalpha,466,73.8,C\nbeta,377,84.5,C\ngamma,207,53.6,A\ndelta,811,29.9,F\nepsilon,722,70.3,F\nzeta,629,97.2,F"),
    ("table", "delimited", "repo;files;score;grade\nalpha;198;71.4;B\nbeta;162;63.1;F\ngamma;875;69.2;B\ndelta;464;91.8;A\nepsilon;567;67.1;B\nzeta;11;45.0;C"),
    ("table", "delimited", "name\tunits\tprice\nalpha\t12\t4.50\nbeta\t3\t18.25\ngamma\t40\t1.10\ndelta\t7\t99.00\nepsilon\t1\t5.75"),
    ("table", "marked table", "| file | category | severity | line |\n|---|---|---|---|\n| src/load_row.rb | long_function | high | 324 |\n| core/split_cell.ts | large_file | low | 18 |\n| app/merge_page.go | god_class | medium | 77 |\n| lib/trim_log.py | todo_debt | low | 451 |"),
    ("junk", "log", _N.join(f"2025-0{k}-1{k}T21:{k}9:41Z {s} [{a}] n={k * 957} t={k * 31}ms" for k, (s, a) in enumerate([("INFO", "load_row"), ("WARN", "split_cell"), ("ERROR", "merge_page"), ("INFO", "trim_log"), ("DEBUG", "check_lock")], 1))),
    ("junk", "trace", "ValueError: queue\n" + _N.join(f"    at {a}.{b}({d}:{k * 71}:{k * 9})" for k, (a, b, d) in enumerate([("RowIndex", "loadRow", "src/load_row.rb"), ("CellStore", "splitCell", "lib/split_cell.go"), ("PageView", "mergePage", "app/merge_page.ts"), ("LogPolicy", "trimLog", "core/trim_log.java")], 1))),
    ("junk", "code", "def load_row1(inner, strict2=None):\n    split_cell(outer - 79, \"path\")\n    if inner > 4 and strict2:\n        return merge_page(inner, 12)\n    total += 3\n    return None\n\nfunction checkLock(a, b) {\n  const c = trimLog(a + 81);\n  return c;\n}"),
    ("junk", "code", "func loadRow1(outer int, partial2 string) int {\n\tif inner >= 85 && recent < 37 {\n\t\tsplitCell(42, recent + 12)\n\t}\n\tfor i := 0; i < 9; i++ {\n\t\ttotal += i\n\t}\n\treturn 0\n}"),
    ("junk", "numbers", "80232\n51610\n59090\n236\n76029\n19324\n32594\n92895\n94330\n99016\n23480\n46880\n79984\n35781"),
    ("junk", "numbers", "2373, 60861, 33362, 40464, 62695, 91669, 5934, 15354, 96062, 7160, 16804, 9762, 20990, 39425"),
    ("junk", "hex", "983d75fc60e4ffbcacefa3ee214aa0af9655c54f0b8e74d7e4ae2a546732c214c8cf63ee323f9d223e3710f835f6176d21126dbe64e1378806a36ca1f794ad69798e8dcef10902b4"),
    ("junk", "base64", "71a6DwKbYVf0Ixa/T+pDPbBldtr65SjhCC8h27Mnov6Bui32JvqmYgVaPsYAcQ80Ij8x2whESe3F\nLmaWhytoa5jJ2PrNFppp2MmBVY6u2x8EsDQcqWvUbPgFQP0ZHJx4GypuLYG+MEoPNocQzAyfdDci"),
    ("junk", "gibberish", "rukfgalob lqxyadbhq qfiotcbq lcpo scuannn tocplekx tyxxex ymeuia ugritkk zly ezbmnek dsdzwd puztqdk jqreqeb qgeyw dhu tvwy wfwy utljo grbhi ofbdar nety."),
    ("junk", "salad", "harmless empty connection shell looks line, state often reads second import point seconds whole tests constant change, first earlier reviewer swallows closes shard early value minutes lines basket limits versions calls"),
    ("junk", "salad", "audit dropped state matters caller writes people high, written fails minutes shared sprint never check_row another waits repository traffic fair, thread nobody meant, According buffer folder, shorter, waits relay shared scan works"),
    ("junk", "furniture", "Home | Findings | Plan | Graph | Settings\nNext »\n0 results\nSign in\nExport (json)\nFilter: all\nTheme: dark\n0 results\nMenu\n« Back\nNext »\nShare\nMenu\nSign in"),
    ("junk", "repeated", "click here " * 24),
    ("junk", "repeated", "skip to content\n" * 18),
    ("junk", "symbols", "< *_-<#>~__\\\\.+=_./_#- >\\>-_.-.>=*.<=#>#==/\\|+>+~|.\n/-|+//.-/\\~#>_+/_=<<<~--~|=-.\\\\/\\ / #<+-#~==~|/< |<#->>._ </"),
    ("junk", "garbled", "EstÃ©Â archivoÂ haÂ crÃ©cidoÂ tantoÂ quÃ©Â yaÂ nadiÃ©Â loÂ Ã©ntiÃ©ndÃ©.Â LaÂ clasÃ©Â sÃ©Â usaÂ Ã©nÂ ochoÂ lugarÃ©s."),
    ("junk", "data", '{"id": 12, "name": "alpha", "tags": ["x", "y"], "n": 9, "ok": true}\n{"id": 13, "name": "beta", "tags": [], "n": 4, "ok": false}\n{"id": 14, "name": "gamma", "tags": ["z"], "n": 71, "ok": true}'),
]


def start() -> tuple[np.ndarray, list[str]]:
    """Raw means of the example groups, and their classes."""
    groups: dict[str, list[list[float]]] = {}
    label: dict[str, str] = {}
    for cls, group, text in EXAMPLES:
        groups.setdefault(group, []).append(measure(text)[1])
        label[group] = cls
    return np.array([np.mean(v, 0) for v in groups.values()]), [label[g] for g in groups]


def statistics(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Per non-blank text its open statistics and the mixture's."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(i, *seen, x) for i, t in f.itertuples(index=False) if t and t.strip() for seen, x in [measure(t)]]
            yield pd.DataFrame(rows, columns=["id", *OPEN, "x"])

    kinds = "id bigint, n_chars double, n_words double, " + ", ".join(f"{c} double" for c in OPEN[2:]) + ", x array<double>"
    return spread(df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))).mapInPandas(run, kinds)


def _log_density(z: np.ndarray, model: dict) -> np.ndarray:
    out = np.empty((len(z), len(model["weights"])))
    d = z.shape[1]
    for k, (w, m, c) in enumerate(zip(model["weights"], model["means"], model["covs"])):
        low = np.linalg.cholesky(c)
        y = np.linalg.solve(low, (z - m).T)
        out[:, k] = np.log(w) - np.log(np.diag(low)).sum() - 0.5 * (y * y).sum(0) - 0.5 * d * np.log(2 * np.pi)
    return out


def expected(z: np.ndarray, model: dict) -> tuple[np.ndarray, float]:
    """(responsibilities, log-likelihood) of rows under a mixture."""
    log = _log_density(z, model)
    top = log.max(1, keepdims=True)
    p = np.exp(log - top)
    return p / p.sum(1, keepdims=True), float((np.log(p.sum(1)) + top[:, 0]).sum())


def responsibilities(z: np.ndarray, model: dict) -> np.ndarray:
    return expected(z, model)[0]


def fit(stats: DataFrame, rounds: int = 8, ridge: float = 0.06, prior: float = 0.004, gain: float = 0.002) -> dict | None:
    """The mixture over all rows of ``stats``; None for an empty table.

    A round sends the driver one row per component and entry, whatever the table's size.
    Rounds end when a row's mean log-likelihood gains less than ``gain``, or after ``rounds``.
    ``prior`` is the weight of a start as a share of all rows, so that a component keeps
    its class at every size.
    """
    d = len(STATS)
    moments = stats.select(F.count(F.lit(1)), *(F.avg(F.col("x")[k]) for k in range(d)), *(F.stddev_pop(F.col("x")[k]) for k in range(d))).first()
    total = moments[0]
    if not total:
        return None
    raw, classes = start()
    centre = np.array(moments[1 : d + 1], float)
    scale = np.maximum(np.array(moments[d + 1 :], float), 0.02)
    seeds = (raw - centre) / scale
    k = len(seeds)
    model = {"centre": centre, "scale": scale, "classes": classes, "weights": np.full(k, 1 / k), "means": seeds, "covs": np.array([np.eye(d) * 0.5] * k)}
    hold = max(3.0, prior * total)
    likely = -np.inf
    for _ in range(rounds):
        now = model

        def run(frames: Iterator[pd.DataFrame], now: dict = now) -> Iterator[pd.DataFrame]:
            # per component: its weight, sums, products; the last entry of the first one is the log-likelihood
            sums = np.zeros((k, 2 + d + d * d))
            for f in frames:
                if len(f):
                    z = (np.stack(f["x"].to_numpy()) - now["centre"]) / now["scale"]
                    r, likely = expected(z, now)
                    sums[0, -1] += likely
                    sums[:, 0] += r.sum(0)
                    sums[:, 1 : 1 + d] += r.T @ z
                    for j in range(k):
                        sums[j, 1 + d : -1] += ((z * r[:, j : j + 1]).T @ z).ravel()
            yield pd.DataFrame({"k": range(k), "s": list(sums)})

        parts = stats.select("x").mapInPandas(run, "k int, s array<double>")
        flat = parts.select("k", F.posexplode("s")).groupBy("k", "pos").agg(F.sum("col").alias("v")).collect()
        sums = np.zeros((k, 2 + d + d * d))
        for row in flat:
            sums[row[0], row[1]] = row[2]
        now_likely, sums = sums[0, -1] / total, sums[:, :-1]
        if now_likely - likely < gain:
            break
        likely = now_likely
        n = sums[:, 0]
        means = (sums[:, 1 : 1 + d] + hold * seeds) / (n + hold)[:, None]
        covs = np.empty((k, d, d))
        for j in range(k):
            own = sums[j, 1 : 1 + d]
            scatter = sums[j, 1 + d :].reshape(d, d) - np.outer(own, means[j]) - np.outer(means[j], own) + n[j] * np.outer(means[j], means[j])
            covs[j] = (scatter + hold * (0.3 * np.eye(d) + np.outer(seeds[j] - means[j], seeds[j] - means[j]))) / (n[j] + hold) + ridge * np.eye(d)
        model = now | {"weights": (n + hold) / (n + hold).sum(), "means": means, "covs": covs}
    return model


def classified(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Statistics and ``text_class`` (prose, list, table or junk) of every non-blank text.

    Null, empty and blank texts give no row; an empty table gives none; equal texts get
    equal rows.
    """
    stats = durable(statistics(df, id_col, text_col))
    model = fit(stats)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = sorted(set(model["classes"]))
        member = np.array([[c == x for c in names] for x in model["classes"]], float)
        for f in frames:
            if len(f):
                z = (np.stack(f["x"].to_numpy()) - model["centre"]) / model["scale"]
                p = responsibilities(z, model) @ member
                yield f[["id", *OPEN]].assign(prose=p[:, names.index("prose")], text_class=[names[j] for j in p.argmax(1)])

    kinds = "id bigint, n_chars double, n_words double, " + ", ".join(f"{c} double" for c in OPEN[2:]) + ", prose double, text_class string"
    if model is None:
        return df.sparkSession.createDataFrame([], kinds)
    return stats.mapInPandas(run, kinds)


def not_prose(documents: DataFrame) -> DataFrame:
    return classified(documents).where("text_class <> 'prose'").select(F.col("id").alias("doc_id"))
