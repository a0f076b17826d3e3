"""Visually identical text with different characters, brought to one form.

The form is computed by DuckDB inside each Arrow partition, as embedded SQL: nfc_normalize composes accents
and Hangul and replaces compatibility ideographs, translate maps full-width forms, radicals and look-alike
letters, regular expressions remove what is invisible and turn every kind of space into one.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC = ("АВЕЅІЈКМНОРСТУХҮԌԚԜҺаеѕіјорсухүһԁԛԝ", "ABESIJKMHOPCTYXYGQWhaesijopcyxyhdqw")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳονυϲ", "ABEZHIKMNOPTYXCjovuc")
LATIN = ("ÐƉɑɡǃ", "ĐĐag!")
HYPHENS = ("‐‑‒−﹣", "-----")
# Katakana that look like a Han character, and that character.
KATAKANA = ("エカタトニハロチ", "工力夕卜二八口千")
_OTHER_KANA = r"[\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}]"

_INVISIBLE = (
    r"[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}"
    r"\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}\x{E0000}-\x{E0FFF}]"
)
_SPACES = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _by_rule() -> tuple[str, str]:
    """Full-width and half-width forms and the radicals of the Kangxi block with their plain characters,
    by Unicode's own compatibility mapping where that is one character."""
    blocks = (*range(0x2E80, 0x2FD6), *range(0xFF01, 0xFFEF))
    pairs = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in blocks]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def form_sql(column: str = "t", source: str = "batch") -> str:
    """The embedded SQL: all columns of source, and ``form``."""
    ruled, letters = _by_rule(), (CYRILLIC, GREEK, LATIN, HYPHENS)
    old, new = ruled[0] + "".join(x for x, _ in letters), ruled[1] + "".join(x for _, x in letters)
    bare = f"regexp_replace({column}, '{_INVISIBLE}', '', 'g')"
    composed = f"nfc_normalize({bare})"
    # Only texts with a character of the mapped blocks pay for the large translation.
    touched = rf"[\x{{0100}}-\x{{03FF}}\x{{0400}}-\x{{052F}}\x{{00D0}}\x{{2010}}-\x{{2212}}\x{{2E80}}-\x{{2FD5}}\x{{FB00}}-\x{{FB06}}\x{{FE63}}\x{{FF01}}-\x{{FFEE}}]"
    ligatures = "translated"
    for c in range(0xFB00, 0xFB07):
        ligatures = f"replace({ligatures}, '{chr(c)}', '{unicodedata.normalize('NFKC', chr(c))}')"
    kana_left = f"translate(joined, {_quoted(KATAKANA[0])}, '')"
    return rf"""
    with composed as (select *, {composed} as composed from {source}),
    translated as (select * exclude composed, case when regexp_matches(composed, '{touched}') then translate(composed, {_quoted(old)}, {_quoted(new)}) else composed end as translated from composed),
    joined as (select * exclude translated, case when regexp_matches(translated, '[\x{{FB00}}-\x{{FB06}}]') then {ligatures} else translated end as joined from translated),
    han as (
      select * exclude joined,
        case when regexp_matches(joined, '[{KATAKANA[0]}]') and not regexp_matches({kana_left}, '{_OTHER_KANA}') and regexp_matches(joined, '\p{{Han}}')
          then translate(joined, {_quoted(KATAKANA[0])}, {_quoted(KATAKANA[1])}) else joined end as han
      from joined
    )
    select * exclude han, trim(regexp_replace(nfc_normalize(han), '{_SPACES}', ' ', 'g')) as form from han
    """


def with_visual_form(df: DataFrame, column: str) -> DataFrame:
    """df and ``visual_form``, one form for all texts of column that look the same.

    Defined cases: null stays null; empty and wholly invisible texts become empty; inner spaces of any kind
    and number become one, outer ones vanish; katakana that look like Han characters become those only in
    texts that have Han characters and no other kana; Han variants, simplified characters and case are
    kept apart; texts of any length pass whole. An existing column visual_form is replaced.
    """
    df = df.drop("visual_form")
    sql, names = form_sql(), df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        # No spilling: a worker's own folder is no place for it, and a batch that needs more should fail loudly.
        con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""})
        for batch in batches:
            if not batch.num_rows:
                continue
            con.register("batch", pa.table({"t": batch.column(len(names)), "n": pa.array(range(batch.num_rows), pa.int64())}))
            form = con.sql(f"select form from ({sql}) order by n").to_arrow_table().column(0).combine_chunks().cast(pa.string())
            con.unregister("batch")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], form], names=[*names, "visual_form"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.select(*df.columns, F.col(column).cast("string").alias("_text")).mapInArrow(run, f"{fields}, visual_form string")


def _spellings(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the rows with their form, each distinct spelling of a form with the number of its rows)."""
    formed = with_visual_form(rows.select("table_name", "row_no", "text").where("text is not null").distinct(), "text").where("visual_form <> ''")
    return formed, formed.groupBy("table_name", "visual_form", "text").agg(F.count("*").alias("n"))


def lookalike_classes(rows: DataFrame) -> DataFrame:
    """rows (table_name, row_no, text) -> table_name, visual_form, spellings, rows: the forms that occur in
    more than one spelling, one row each, whatever the number of their rows."""
    _, spellings = _spellings(rows)
    counted = spellings.groupBy("table_name", "visual_form").agg(F.count("*").alias("spellings"), F.sum("n").alias("rows"))
    return counted.where("spellings > 1")


def lookalike_pairs(rows: DataFrame) -> DataFrame:
    """rows (table_name, row_no, text) -> table_name, row_no_a, row_no_b: rows of one table whose texts
    look the same but differ in code points, the smaller number first.

    Pairs are made between spellings, never within one: the rows of a spelling are joined through the pairs of
    spellings of its form, so a title repeated letter for letter a million times costs nothing unless it also
    occurs in another spelling. No list of a form's spellings is gathered; a form of many spellings is joined
    like any heavy key. Null texts and texts without visible character make no pair.
    """
    formed, spellings = _spellings(rows)
    one, two = (spellings.select("table_name", "visual_form", F.col("text").alias(c)) for c in ("a", "b"))
    pairs = one.join(two, ["table_name", "visual_form"]).where("a < b").select("table_name", "a", "b")
    a = formed.select("table_name", F.col("text").alias("a"), F.col("row_no").alias("x"))
    b = formed.select("table_name", F.col("text").alias("b"), F.col("row_no").alias("y"))
    return (
        pairs.join(a, ["table_name", "a"])
        .join(b, ["table_name", "b"])
        .where("x <> y")
        .select("table_name", F.least("x", "y").alias("row_no_a"), F.greatest("x", "y").alias("row_no_b"))
        .distinct()
    )
