"""Which document type a text is, and which schema it goes to."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ELECTRICITY, GAS, OFFER, OTHER = "bolletta_luce", "bolletta_gas", "cte", "sconosciuto"
#: The words that tell.
BILL_WORDS, OFFER_WORDS = "totale da pagare", ("condizioni economiche", "codice offerta")
FIRST_PAGES = 3
SCHEMAS = {ELECTRICITY: "bolletta_luce_it", GAS: "bolletta_gas_it", OFFER: "cte_it"}
FALLBACK = "bolletta_luce_it"


def classify(text: Column) -> Column:
    t = F.lower(F.coalesce(text, F.lit("")))
    gas, electric = F.regexp_like(t, F.lit(r"(?U)\bsmc\b")), F.regexp_like(t, F.lit(r"(?U)\bkwh\b"))
    offer = F.contains(t, F.lit(OFFER_WORDS[0])) | F.contains(t, F.lit(OFFER_WORDS[1]))
    return F.when(~F.contains(t, F.lit(BILL_WORDS)), F.when(offer, OFFER).otherwise(OTHER)).when(gas & ~electric, GAS).when(electric & ~gas, ELECTRICITY).otherwise(OTHER)


def classify_files(pages: DataFrame, first_pages: int = FIRST_PAGES) -> DataFrame:
    """(file, class, schema, fell_back) from the raw text of each file's first pages, joined by spaces; no class falls back to electricity, with a mark."""
    raw = "raw_text" if "raw_text" in pages.columns else "text"
    page = F.struct("page_no", F.coalesce(raw, F.lit("")).alias("text"))
    some = pages.groupBy("file").agg(F.array_sort(F.collect_list(F.when(F.col("page_no") <= first_pages, page))).alias("p"))
    out = some.select("file", classify(F.array_join(F.transform("p", lambda x: x["text"]), " ")).alias("class"))
    schema = F.coalesce(*[F.when(F.col("class") == c, s) for c, s in SCHEMAS.items()], F.lit(FALLBACK))
    return out.withColumn("schema", schema).withColumn("fell_back", F.col("class") == OTHER)
