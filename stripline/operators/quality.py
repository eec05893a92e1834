"""Checks of page sizes, sequences, PDF limits and balance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stripline.functions.rules import DIM_TOLERANCE, dim_class, pdf_units, width_difference, within_pdf_limits
from stripline.operators.blocks import neighbours

CH = ["ch"]
SPREAD = 4096  # page numbers per group of the sequence check


def width_histogram(pages: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    return pages.filter("width is not null").groupBy(*keys, "width").agg(F.count(F.lit(1)).alias("n"))


def dominant_width(pages: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Most frequent width, the smallest on a tie."""
    return width_histogram(pages, keys).groupBy(*keys).agg(
        F.min_by("width", F.struct(-F.col("n"), "width")).alias("dominant"), F.max("n").alias("uses"))


def classified(pages: DataFrame, keys: Sequence[str] = CH, tolerance: float = DIM_TOLERANCE) -> DataFrame:
    """Readable and unreadable pages with dominant width, difference and class."""
    w, d = F.col("width"), F.col("dominant")
    return pages.join(dominant_width(pages, keys).drop("uses"), list(keys)).withColumns({
        "difference_px": F.abs(w - d), "difference_percent": F.round(width_difference(w, d), 3), "class": dim_class(w, d, tolerance)})


def chapter_summary(pages: DataFrame, keys: Sequence[str] = CH, tolerance: float = DIM_TOLERANCE) -> DataFrame:
    """Size summary of every chapter; unreadable pages and exceptions ask for an analysis."""
    c = F.col("class")
    s = classified(pages, keys, tolerance).groupBy(*keys).agg(
        F.count("width").alias("image_count"), F.min("width").alias("min_width"), F.max("width").alias("max_width"),
        F.max("dominant").alias("dominant"), F.count_if(c.isin("PADRAO", "DENTRO_TOLERANCIA")).alias("within"),
        F.count_if(c == "EXCECAO_DIMENSAO").alias("exceptions"), F.count_if(F.col("width").isNull()).alias("unreadable"))
    status = (F.when(F.col("image_count") == 0, "SEM_IMAGENS_VALIDAS")
              .when((F.col("exceptions") == 0) & (F.col("unreadable") == 0), "OK").otherwise("REQUER_ANALISE"))
    return s.withColumns({"tolerance_px": F.round(F.col("dominant") * tolerance / 100.0, 2), "status": status})


def run_summary(chapters: DataFrame) -> DataFrame:
    return chapters.agg(
        F.count(F.lit(1)).alias("chapters_analyzed"), F.count_if(F.col("status") == "OK").alias("chapters_ok"),
        F.count_if(F.col("status") == "REQUER_ANALISE").alias("chapters_requiring_analysis"))


def upsert_current(current: DataFrame, analysed: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Report rows with the analysed chapters replaced and all others kept."""
    return current.join(analysed, list(keys), "left_anti").unionByName(analysed)


def resize_plan(pages: DataFrame, backup_exists: Column, keys: Sequence[str] = CH, tolerance: float = DIM_TOLERANCE) -> DataFrame:
    """Target size and backup name of every exception; one existing backup blocks the whole chapter."""
    keys = list(keys)
    x = classified(pages, keys, tolerance).filter(F.col("class") == "EXCECAO_DIMENSAO").withColumns({
        "target_height": F.greatest(F.lit(1), F.bround(F.col("height") * (F.col("dominant") / F.col("width"))).cast("long")),
        "backup": F.regexp_replace("file", r"(\.[^.]+)$", "_old$1"), "blocked": backup_exists})
    stop = x.groupBy(*keys).agg(F.max("blocked").alias("chapter_blocked"))
    return x.join(stop, keys)


def report_lines(pages: DataFrame, keys: Sequence[str] = CH, tolerance: float = DIM_TOLERANCE) -> DataFrame:
    """Text report as ordered lines: (chapter, section, item, line)."""
    keys = list(keys)
    s = chapter_summary(pages, keys, tolerance)
    hist = width_histogram(pages, keys).groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("width", "n"))),
                                 lambda r: F.concat(F.lit("'"), r["width"].cast("string"), F.lit("': "), r["n"].cast("string"))), ", ").alias("widths"))
    t = lambda c: F.col(c).cast("string")
    lines = F.array(
        F.concat(F.lit("CAPÍTULO "), F.concat_ws("/", *keys), F.lit(" — "), "status"),
        F.concat(F.lit("Imagens: "), t("image_count")),
        F.concat(F.lit("Largura dominante: "), t("dominant"), F.lit("px")),
        F.concat(F.lit("Faixa observada: "), t("min_width"), F.lit("px – "), t("max_width"), F.lit("px")),
        F.concat(F.lit("Tolerância em pixels: ±"), t("tolerance_px"), F.lit("px")),
        F.concat(F.lit("Distribuição: {"), "widths", F.lit("}")),
        F.concat(F.lit("Dentro do padrão/tolerância: "), t("within"), F.lit(" · Exceções: "), t("exceptions")))
    head = s.join(hist, keys).select(*keys, F.posexplode(lines).alias("section", "line")).withColumn("item", F.lit(""))
    x = classified(pages, keys, tolerance).filter(F.col("class") == "EXCECAO_DIMENSAO").select(
        *keys, F.lit(7).alias("section"), F.col("file").alias("item"),
        F.format_string("  %-24s %dx%d · diferença %dpx (%.3f%%)", "file", "width", "height", "difference_px", "difference_percent").alias("line"))
    return head.unionByName(x)


def pdf_limits(pages: DataFrame) -> DataFrame:
    """PDF units of every readable page and whether both sides are within the limits."""
    p = pages.filter("width is not null").withColumns({
        "pdf_width": pdf_units(F.col("width"), F.col("dpi")), "pdf_height": pdf_units(F.col("height"), F.col("dpi"))})
    return p.withColumn("pdf_ok", within_pdf_limits(F.col("pdf_width")) & within_pdf_limits(F.col("pdf_height")))


def sequence_gaps(pages: DataFrame, keys: Sequence[str] = CH, number: str = "page_no") -> DataFrame:
    """Missing page numbers from 1 to the highest; chapters with an unnumbered page are left out.

    Numbers are compared in groups of ``SPREAD``, so no chapter is gathered as a whole.
    """
    keys = list(keys)
    top = pages.groupBy(*keys).agg(F.max(number).alias("_top"), F.count_if(F.col(number).isNull()).alias("_bad")).filter("_bad = 0")
    groups = top.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("_top") / SPREAD))))
    have = pages.filter(F.col(number).isNotNull()).groupBy(*keys, F.floor(F.col(number) / SPREAD).alias("_b")).agg(F.collect_set(number).alias("_have"))
    lo = F.greatest(F.col("_b") * SPREAD, F.lit(1))
    hi = F.least(F.col("_b") * SPREAD + SPREAD - 1, F.col("_top"))
    want = F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))
    miss = F.array_except(want, F.coalesce(F.col("_have"), F.array().cast("array<bigint>")))
    return groups.join(have, [*keys, "_b"], "left").select(*keys, F.explode(miss).alias("missing"))


def total_check(pages: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Found against expected pages; no expectation is no error."""
    return pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("found"), F.max(expected).alias("expected")).withColumn(
        "mismatch", F.coalesce(F.col("found") != F.col("expected"), F.lit(False)))


# The messages of the image checks.
NO_IMAGES = "Nenhuma imagem compatível encontrada no capítulo."
UNREADABLE = "Imagem ilegível: %s (%s)."
OUTSIDE = "Imagem incompatível com os limites do PDF/img2pdf: %s (%dx%d, %s, %s) gera %.2fx%.2f unidades PDF."


def chapter_errors(pages: DataFrame, keys: Sequence[str], expected: str) -> DataFrame:
    """Every sequence and total error as a row, in report order."""
    keys = list(keys)
    total = total_check(pages, keys, expected).filter("mismatch").select(
        *keys, F.lit(1).alias("ord"), F.lit(0).cast("long").alias("item"),
        F.concat(F.lit("Total de imagens divergente: esperado "), F.col("expected").cast("string"), F.lit(", encontrado "),
                 F.col("found").cast("string"), F.lit(".")).alias("error"))
    gaps = sequence_gaps(pages, keys).select(
        *keys, F.lit(2).alias("ord"), F.col("missing").alias("item"),
        F.format_string("Sequência de páginas incompleta: faltando page-%03d.", "missing").alias("error"))
    return total.unionByName(gaps)


def image_errors(chapters: DataFrame, images: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Errors of chapters without images, of unreadable images and of images outside the PDF limits: keys, ``ord``, ``file``, ``error``.

    ``images``: keys, ``file``, ``width`` (null: unreadable, with the ``problem``), ``height``, ``dpi``, ``format``, ``mode``.
    """
    keys = list(keys)
    none = chapters.select(*keys).distinct().join(images.select(*keys).distinct(), keys, "left_anti").select(
        *keys, F.lit(0).alias("ord"), F.lit("").alias("file"), F.lit(NO_IMAGES).alias("error"))
    bad = images.filter("width is null").select(*keys, F.lit(3).alias("ord"), "file", F.format_string(UNREADABLE, "file", "problem").alias("error"))
    out = pdf_limits(images).filter("not pdf_ok").select(
        *keys, F.lit(3).alias("ord"), "file", F.format_string(OUTSIDE, "file", "width", "height", "format", "mode", "pdf_width", "pdf_height").alias("error"))
    return none.unionByName(bad).unionByName(out)


def validation_result(chapters: DataFrame, errors: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """Number of errors of every chapter and whether it is ``ok``."""
    keys = list(keys)
    n = errors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_errors"))
    return chapters.select(*keys).distinct().join(n, keys, "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0))).withColumn("ok", F.col("n_errors") == 0)


def batch_route(chapters: DataFrame, regenerate: bool = False) -> DataFrame:
    """Where a batch sends every chapter: skip, block, report or generate, first matching rule wins.

    Needs ``pdf_exists``, ``in_progress``, ``bad_marker`` and ``n_errors``.
    """
    return chapters.withColumn("route", F.when(F.col("pdf_exists") & ~F.lit(regenerate), "skipped")
                               .when(F.col("in_progress"), "download_not_completed")
                               .when(F.col("bad_marker"), "download_state_invalid")
                               .when(F.col("n_errors") > 0, "image_validation_failed").otherwise("generated"))


def batch_summary(routed: DataFrame, failed: str | None = None) -> DataFrame:
    """Chapters by what became of them; ``failed`` names the flag of those sent to generation that produced no valid document."""
    r = F.col("route")
    broke = F.coalesce(F.col(failed), F.lit(False)) if failed else F.lit(False)
    return routed.agg(
        F.count(F.lit(1)).alias("selected"), F.count_if((r == "generated") & ~broke).alias("generated"), F.count_if(r == "skipped").alias("skipped"),
        F.count_if(~r.isin("generated", "skipped")).alias("validation_failed"), F.count_if((r == "generated") & broke).alias("generation_failed"))


def neighbor_balance(pieces: DataFrame, keys: Sequence[str] = CH, number: str = "seg", ratio: float = 0.50) -> DataFrame:
    """Inner pieces lower than half the mean height of their two neighbours."""
    n = neighbours(pieces, keys, number, {"prev_h": "height"}, {"next_h": "height"}).filter(
        (F.col("height") > 0) & (F.col("prev_h") > 0) & (F.col("next_h") > 0))
    mean = (F.col("prev_h") + F.col("next_h")) / 2.0
    return n.withColumns({"neighbor_mean": F.round(mean, 2), "ratio": F.round(F.col("height") / mean, 4)}).filter(F.col("height") / mean < ratio)


def balance_summary(pieces: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    bad = neighbor_balance(pieces, keys).select(*keys).distinct().withColumn("bad", F.lit(1))
    return pieces.select(*keys).distinct().join(bad, list(keys), "left").agg(
        F.count(F.lit(1)).alias("chapters"), F.count("bad").alias("unbalanced"),
        F.count_if(F.col("bad").isNull()).alias("balanced"))


# Labels of issue types, and the lines of a narrative.
ISSUE_LABELS = {
    "image_validation_failed": "Imagem incompatível",
    "pdf_page_count_mismatch": "Páginas do PDF divergentes",
    "pdf_validation_failed": "Validação do PDF",
    "download_not_completed": "Download em andamento",
    "download_state_invalid": "Estado de download inválido",
}
CONCLUSIONS = {
    "pdf_page_count_mismatch": ("As imagens do capítulo foram validadas.", "O PDF gerado apresentou quantidade de páginas divergente."),
    "download_not_completed": ("O capítulo ainda estava em download.", "A geração do PDF foi bloqueada para evitar um arquivo incompleto."),
    "download_state_invalid": ("O estado persistente do capítulo não pôde ser validado.", "A geração do PDF foi bloqueada por segurança."),
}
ACTIONS = {
    "pdf_page_count_mismatch": "Comparar a quantidade de imagens com as páginas do PDF antes de gerar novamente.",
    "download_not_completed": "Aguardar a conclusão do download antes de gerar o PDF.",
    "download_state_invalid": "Revisar o estado do capítulo antes de tentar gerar o PDF.",
}


def divergence_lines(reports: DataFrame, bad: DataFrame, metadata: DataFrame, keys: Sequence[str] = CH) -> DataFrame:
    """The narrative of every divergence report as ordered lines: keys, ``section``, ``page``, ``k``, ``line``.

    reports: keys, ``name``, ``issue_type``, ``message``, ``pdf_generated``, ``expected``, ``found``, ``pdf_expected``, ``pdf_found``; bad: keys, ``file`` of the images that the
    report's errors name; metadata: keys, ``file``, ``width``, ``height``, ``pdf_width``, ``pdf_height``.  Sections: 0 the report in the list, 1 title, 2 validation,
    3 divergence, 4 conclusion, 5 suggested action; ``page`` is that of an incompatible image, else 0.
    """
    keys, t = list(keys), F.concat
    say = lambda c: F.col(c).cast("string")
    page = lambda c: F.regexp_extract(c, r"(?i)page-(\d+)", 1)
    bad = bad.select(*keys, "file").distinct()
    number = F.when(F.col("file").rlike(r"(?i)^page-\d+\.[^.]+$"), page("file").cast("long"))
    meta = metadata.withColumn("_no", number).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_meta"), F.count("_no").alias("_nos"), F.count_distinct("_no").alias("_different"), F.min("_no").alias("_low"), F.max("_no").alias("_high"))
    b = bad.groupBy(*keys).agg(F.count(F.lit(1)).alias("_bad"), F.min_by(page("file"), page("file").cast("long")).alias("_page"))
    r = reports.join(meta, keys, "left").join(b, keys, "left").na.fill(0, ["_meta", "_nos", "_bad"])
    exp, found = F.col("expected"), F.col("found")
    seq = F.coalesce((exp > 0) & (F.col("_nos") == exp) & (F.col("_different") == exp) & (F.col("_low") == 1) & (F.col("_high") == exp), F.lit(False))
    complete = F.coalesce(exp == found, F.lit(False)) & ((F.col("_nos") == 0) | seq)
    issue, message = F.coalesce("issue_type", F.lit("")), F.coalesce(F.col("message"), F.lit(""))
    images = (issue == "image_validation_failed") & (F.col("_bad") > 0)
    label = F.coalesce(F.create_map(*[F.lit(x) for kv in ISSUE_LABELS.items() for x in kv])[issue], F.when(issue != "", issue), F.lit("Divergência"))
    none = F.lit(None).cast("string")
    blocked = F.when(F.col("_bad") == 1, "A geração do PDF foi bloqueada por uma única imagem incompatível").otherwise(
        t(F.lit("A geração do PDF foi bloqueada por "), say("_bad"), F.lit(" imagens incompatíveis")))

    def by_issue(table: dict, k: int | None = None):
        out = none
        for name, value in table.items():
            out = F.when(issue == name, F.lit(value if k is None else value[k])).otherwise(out)
        return out

    mine = (issue == "image_validation_failed") & complete
    sections = {
        0: [F.format_string("%-24s %s", t(F.lit("Capítulo "), F.col("name")), label)],
        1: [t(F.lit("CAPÍTULO "), F.col("name"), F.when(F.col("pdf_generated"), " — PDF GERADO").otherwise(" — PDF NÃO GERADO"))],
        2: [F.lit(""), F.lit("Validação do capítulo"),
            F.when(exp.isNotNull() & found.isNotNull(), t(F.when(exp == found, "✓ ").otherwise("✕ "), say("found"), F.lit(" de "), say("expected"), F.lit(" páginas encontradas")))
            .when(found.isNotNull(), t(F.lit("✓ "), say("found"), F.lit(" páginas encontradas"))),
            F.when((F.col("_nos") > 0) & exp.isNotNull(), F.when(seq, "✓ Sequência completa").otherwise("✕ Sequência de páginas divergente")),
            F.when((found > 0) & (F.col("_meta") == found), "✓ Imagens legíveis")],
        3: [F.lit(""), F.lit("Divergência"),
            F.when(images, none).when(issue == "pdf_page_count_mismatch", t(F.lit("✕ Quantidade de páginas do PDF divergente: esperado "), F.coalesce(say("pdf_expected"), F.lit("None")),
                                                                          F.lit(", encontrado "), F.coalesce(say("pdf_found"), F.lit("None"))))
            .otherwise(t(F.lit("✕ "), F.when(message != "", message).otherwise("Divergência registrada.")))],
        4: [F.lit(""), F.lit("Conclusão"), F.when(mine, "O capítulo está completo.").otherwise(F.coalesce(by_issue(CONCLUSIONS, 0), F.when(message != "", message), F.lit("A divergência requer revisão."))),
            F.when(mine, blocked).otherwise(by_issue(CONCLUSIONS, 1)), F.when(mine, "com a regra de segurança do PDF.")],
        5: [F.lit(""), F.lit("Ação sugerida"),
            F.when(images & (F.col("_bad") == 1), t(F.lit("Revisar visualmente a página "), F.col("_page").cast("long").cast("string"), F.lit(" antes de decidir por exceção/correção.")))
            .when(images, "Revisar visualmente as páginas divergentes antes de decidir por exceção/correção.").otherwise(F.coalesce(by_issue(ACTIONS), F.lit("Revisar os detalhes técnicos do relatório.")))],
    }
    line = lambda n, k, v: F.struct(F.lit(n).alias("section"), F.lit(0).cast("long").alias("page"), F.lit(k).alias("k"), v.alias("line"))
    whole = r.select(*keys, F.explode(F.array(*[line(n, k, v) for n, vs in sections.items() for k, v in enumerate(vs)])).alias("x")).select(*keys, "x.*").filter("line is not null")
    size = lambda a, z: t(F.format_string("%.2f", F.col(a).cast("double")), F.lit("x"), F.format_string("%.2f", F.col(z).cast("double")))
    d = bad.join(r.filter(images).select(*keys), keys, "left_semi").join(metadata, [*keys, "file"], "left")
    each = [t(F.lit("✕ "), F.col("file")), F.when(F.col("width").isNotNull(), t(F.lit("  Dimensão da imagem: "), say("width"), F.lit("x"), say("height"))),
            F.when(F.col("pdf_width").isNotNull() & F.col("pdf_height").isNotNull(), t(F.lit("  Dimensão no PDF: "), size("pdf_width", "pdf_height"))),
            F.lit("  Motivo: altura/dimensão abaixo do mínimo permitido")]
    rows = F.array(*[F.struct(F.lit(3).alias("section"), page("file").cast("long").alias("page"), F.lit(k + 2).alias("k"), v.alias("line")) for k, v in enumerate(each)])
    return whole.unionByName(d.select(*keys, F.explode(rows).alias("x")).select(*keys, "x.*").filter("line is not null"))
