"""One ledger shape from sheets, document feeds and posted lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from reckonry.functions import fixed_values as fv
from reckonry.functions.scalars import bind, is_null_token, normalize_text, parse_date, parse_iso_date, to_decimal
from reckonry.plans.skew import lookup

LEDGER = (
    ("occurred_on", "date"), ("kind", "string"), ("category", "string"), ("amount", "decimal(18,2)"),
    ("currency", "string"), ("account", "string"), ("description", "string"), ("product", "string"),
    ("location", "string"), ("counterparty", "string"), ("quantity", "decimal(18,4)"), ("source_ref", "string"),
    ("classified_by", "string"),
)
SKIPS = "reason string, detail string"
ROLES = tuple(role for role, _ in fv.COLUMN_ROLES)


class LedgerError(ValueError):
    """A source that cannot be read as a ledger; the message is safe to show."""


def to_ledger(df: DataFrame, *keep: str) -> DataFrame:
    """Fixed columns and types, and those to keep; a missing column is empty."""
    have = set(df.columns)
    return df.select(*[
        (F.col(n) if n in have else F.lit(None)).cast(t).alias(n) for n, t in LEDGER], *keep)


# ---------------------------------------------------------------- classification


def _generic(kind: Column, confidence: str) -> Column:
    category = F.when(kind == "revenue", "other_income").when(kind == "cogs", "purchases").otherwise("other_expense")
    final = F.when(kind.isin("revenue", "cogs"), kind).otherwise("expense")
    return F.struct(category.alias("category"), final.alias("kind"), F.lit(confidence).alias("classified_by"))


def _any_word(text: Column, words) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def account_class(account: Column, description: Column, hint: Column) -> Column:
    """struct<category, kind, classified_by>: ordered keywords; the hint decides the kind."""
    text = F.trim(F.lower(F.concat_ws(" ", F.coalesce(account, F.lit("")), F.coalesce(description, F.lit("")))))
    kinds = F.create_map(*[F.lit(x) for kv in fv.LEDGER_KINDS.items() for x in kv])
    fallback_kind = F.coalesce(hint, F.lit("expense"))
    income = F.struct(
        F.lit("other_income").alias("category"), F.lit("revenue").alias("kind"), F.lit("weak").alias("classified_by"))

    def first_word(text: Column) -> Column:
        word = F
        for category, words in fv.LEDGER_KEYWORDS:
            word = word.when(_any_word(text, words), category)
        return bind(word, lambda category: placed(text, category))

    def placed(text: Column, word: Column) -> Column:
        kind = F.try_element_at(kinds, word)
        matched = F.struct(word.alias("category"), kind.alias("kind"), F.lit("matched").alias("classified_by"))
        return (
            F.when(word.isNotNull() & (hint.isNull() | (hint == kind)), matched)
            .when(word.isNotNull(), _generic(hint, "weak"))
            .when(_any_word(text, fv.GENERIC_INCOME_WORDS) & ~hint.eqNullSafe(F.lit("expense")), income)
            .when(_any_word(text, fv.GENERIC_EXPENSE_WORDS), _generic(fallback_kind, "weak"))
            .otherwise(_generic(fallback_kind, "unmatched")))

    return bind(text, first_word)


def classify(df: DataFrame, account: Column, description: Column, hint: Column) -> DataFrame:
    """Adds category, kind and classified_by.

    Keywords are plain words, looked for in each row: reading rows once costs far less than making them a second time
    for their distinct texts and joining the answers back.
    """
    decided = df.withColumn("__c", account_class(account, description, F.nullif(F.coalesce(hint, F.lit("")), F.lit(""))))
    return decided.select(*df.columns, "__c.category", "__c.kind", "__c.classified_by")


# ---------------------------------------------------------------- sheets


def column_roles(meta: DataFrame, keys: list[str] | None = None, override: dict[str, str] | None = None) -> DataFrame:
    """(keys, role, column) for every sheet in ``meta(keys, column, source_header, inferred_type, position)``.

    Every column is a candidate for each role that one of its words names, ranked by role, then equal
    headers before those that begin with or contain a word, then position; columns of the right type
    come last for the date and, where no money role is filled, the amount. One pass over a sheet's
    ranked candidates takes each whose role and column are both free. All sheets go at once.
    """
    keys = keys or []
    header = F.lower(F.trim(F.coalesce(F.nullif("source_header", F.lit("")), "column")))
    facts = meta.select(*keys, "column", header.alias("header"), "inferred_type", F.col("position").cast("long").alias("position"))

    def entry(rank, column, role, inexact=F.lit(0), position=F.lit(0).cast("long"), fits=F.lit(True)) -> Column:
        return F.when(fits, F.struct(F.lit(rank).alias("rank"), inexact.alias("inexact"), position.alias("position"), F.lit(role).alias("role"), column.alias("column")))

    found = []
    for rank, (role, words) in enumerate(fv.COLUMN_ROLES):
        exact = F.col("header").isin(*words)
        near = reduce(lambda a, b: a | b, [F.col("header").startswith(w) | F.array_contains(F.split("header", r"\s+"), w) for w in words])
        found.append(entry(rank, F.col("column"), role, F.when(exact, 0).otherwise(1), F.col("position"), exact | near))
    for rank, role, kind in ((100, "date", "date"), (101, "amount", "number")):
        found.append(entry(rank, F.col("column"), role, position=F.col("position"), fits=F.col("inferred_type") == kind))
    ranked = facts.select(*keys, F.explode(F.array_compact(F.array(*found))).alias("c")).groupBy(*keys).agg(F.array_sort(F.collect_list("c")).alias("cs"))
    given = [entry(-1, F.lit(column), role) for role, column in (override or {}).items() if column]
    start = F.array(*given) if given else F.array().cast(ranked.schema["cs"].dataType)

    def taken(state: Column, c: Column) -> Column:
        money = (c["rank"] == 101) & F.exists(state, lambda x: x["role"].isin("amount", "income", "expense"))
        return money | F.exists(state, lambda x: (x["role"] == c["role"]) | (x["column"] == c["column"]))

    filled = F.aggregate("cs", start, lambda state, c: F.when(taken(state, c), state).otherwise(F.concat(state, F.array(c))))
    return ranked.select(*keys, F.explode(filled).alias("r")).select(*keys, "r.role", "r.column")


def detect_columns(meta: DataFrame, override: dict[str, str] | None = None) -> dict[str, str]:
    """Role -> column of one sheet; a dozen rows come to the driver at most."""
    named = [c for c in (override or {}).values() if c]
    lost = sorted(set(named) - {r["column"] for r in meta.where(F.col("column").isin(*named)).select("column").collect()}) if named else []
    if lost:
        raise LedgerError(f"the sheet has no column {', '.join(map(repr, lost))}")
    return {r["role"]: r["column"] for r in column_roles(meta, override=override).collect()}


def sheet_shape(roles: dict[str, str]) -> str:
    if "income" in roles or "expense" in roles:
        return "two_column"
    return "typed" if "type" in roles else "signed"


def _sheet_amounts(shape: str, roles: dict[str, str], label: Column) -> Column:
    def amount(role: str) -> Column:
        return to_decimal(F.col(roles[role])) if role in roles else F.lit(None).cast("decimal(18,2)")

    def entry(value: Column, hint: Column) -> Column:
        return F.struct(value.alias("__amount"), hint.alias("__hint"))

    if shape == "two_column":
        return F.array(entry(amount("income"), F.lit("revenue")), entry(amount("expense"), F.lit("expense")))
    if shape == "typed":
        kind = (
            F.when(_any_word(F.lower(label), fv.SHEET_COGS_WORDS), "cogs")
            .when(_any_word(F.lower(label), fv.SHEET_REVENUE_WORDS), "revenue").otherwise("expense"))
        return F.array(entry(amount("amount"), kind))
    return F.array(entry(amount("amount"), F.when(amount("amount") > 0, "revenue").otherwise("expense")))


def entries_from_sheet(
    df: DataFrame, roles: dict[str, str], currency: str = "USD", file: Column | None = None, row: str = "__source_row"
) -> tuple[DataFrame, DataFrame]:
    """(ledger entries, skipped rows).  References carry the file, so another month's sheet never overwrites."""
    shape = sheet_shape(roles)
    if "date" not in roles:
        raise LedgerError("no date column was found in this sheet")
    if shape == "signed" and "amount" not in roles:
        raise LedgerError("no amount column was found in this sheet")

    def text(role: str) -> Column:
        if role not in roles:
            return F.lit("")
        c = F.col(roles[role])
        return F.when(is_null_token(c), "").otherwise(normalize_text(c))

    raw_date = F.col(roles["date"]).cast("string")
    day = F.coalesce(F.substring(F.trim(raw_date), 1, 10).try_cast("date"), parse_date(raw_date)["value"])
    place = F.lit("") if file is None else F.concat(file, F.lit("/"))
    read = df.withColumns({
        "occurred_on": day, "account": text("type"), "description": text("description"), "product": text("product"),
        "location": text("location"), "counterparty": text("counterparty"),
        "currency": F.upper(F.coalesce(F.nullif(text("currency"), F.lit("")), F.lit(currency))),
        "quantity": to_decimal(F.col(roles["quantity"]), 4) if "quantity" in roles else F.lit(None).cast("decimal(18,4)"),
        "__ref": F.concat(place, F.lit("row:"), F.col(row).cast("string"), F.lit(":")),
    })
    skipped = read.where("occurred_on is null").select(
        F.lit("no_date").alias("reason"), F.concat(F.lit("row "), F.col(row).cast("string")).alias("detail"))
    keep = ["occurred_on", "account", "description", "product", "location", "counterparty", "currency", "quantity", "__ref"]
    lines = read.where("occurred_on is not null").select(
        *keep, F.inline(_sheet_amounts(shape, roles, F.col("account")))).where("__amount is not null and __amount <> 0")
    named = F.coalesce(
        F.nullif(F.col("account"), F.lit("")), F.nullif(F.col("description"), F.lit("")),
        F.when(F.col("__hint") == "revenue", "sales").otherwise(""))
    done = classify(lines, named, F.col("description"), F.col("__hint"))
    entries = done.withColumns({
        "amount": F.when(F.col("__hint") == "revenue", F.col("__amount")).otherwise(F.abs("__amount")),
        "source_ref": F.concat("__ref", "__hint")})
    return to_ledger(entries), skipped


# ---------------------------------------------------------------- document feed


def _name_of(ref: Column) -> Column:
    return F.trim(F.coalesce(F.nullif(ref["name"], F.lit("")), ref["value"], F.lit("")))


def entries_from_documents(documents: DataFrame, currency: str = "USD") -> tuple[DataFrame, DataFrame]:
    """``documents(entity, document, malformed)`` with the feed structure -> (entries, skipped)."""
    signs = documents.sparkSession.createDataFrame(
        [(k, d, s) for k, (d, s) in fv.DOCUMENT_TYPES.items()], "entity string, direction string, sign int")
    known = documents.join(F.broadcast(signs), "entity", "left")
    doc = F.col("document")
    unknown = F.col("direction").isNull()
    broken = ~unknown & F.col("malformed")
    day = parse_iso_date(doc["TxnDate"])
    good = known.where(~unknown & ~F.col("malformed"))
    head = good.select(
        "entity", "direction", "sign", doc["Id"].alias("doc_id"), F.coalesce(doc["DocNumber"], F.lit("")).alias("doc_number"),
        day.alias("occurred_on"), to_decimal(doc["TotalAmt"]).alias("total"),
        F.upper(F.coalesce(F.nullif(doc["CurrencyRef"]["value"], F.lit("")), F.nullif(_name_of(doc["CurrencyRef"]), F.lit("")), F.lit(currency))).alias("currency"),
        F.coalesce(F.nullif(_name_of(doc["CustomerRef"]), F.lit("")), _name_of(doc["VendorRef"])).alias("counterparty"),
        _name_of(doc["DepartmentRef"]).alias("location"), doc["Line"].alias("lines"))

    def usable(line: Column) -> Column:
        return ~F.coalesce(line["DetailType"], F.lit("")).isin(*fv.SUMMARY_LINE_TYPES) & F.coalesce(to_decimal(line["Amount"]) != 0, F.lit(False))

    indexed = F.transform(F.coalesce("lines", F.array()), lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    kept = F.filter(indexed, lambda s: usable(s["line"]))
    head = head.withColumn("kept", F.when(F.col("occurred_on").isNotNull(), kept).otherwise(F.slice(kept, 1, 0)))

    # A document makes an entry for each line kept; one without such lines makes one of its total, as a null line.
    total_only = F.col("occurred_on").isNotNull() & (F.coalesce("total", F.lit(0)) != 0)
    one = F.array(F.lit(None).cast(head.schema["kept"].dataType.elementType))
    each = head.withColumn("l", F.explode(F.when(F.size("kept") > 0, F.col("kept")).when(total_only, one)))
    line, whole = F.col("l.line"), F.col("l").isNull()
    detail = lambda f: F.coalesce(*[line[kind][f] for kind in FEED_DETAILS if f in FEED_DETAILS[kind]])
    account, product = F.trim(detail("AccountRef")["name"]), F.trim(detail("ItemRef")["name"])
    account, product = F.coalesce(account, F.lit("")), F.coalesce(product, F.lit(""))
    stock = (F.col("direction") == "expense") & line["DetailType"].isin(*fv.ITEM_LINE_TYPES)
    words = F.coalesce(line["Description"], F.lit(""))

    def either(of_total: Column, of_line: Column) -> Column:
        return F.when(whole, of_total).otherwise(of_line)

    lines = each.select(
        "occurred_on", "currency", "counterparty", "location",
        (either(F.col("total"), to_decimal(line["Amount"])) * F.col("sign")).alias("amount"),
        either(F.col("entity"), F.coalesce(F.nullif(account, F.lit("")), product)).alias("account"),
        product.alias("product"),
        either(F.trim(F.concat_ws(" ", "entity", "doc_number")), words).alias("description"),
        to_decimal(detail("Qty"), 4).alias("quantity"),
        F.when(stock, "cogs").otherwise(F.col("direction")).alias("__hint"),
        F.concat_ws(":", F.lit("qb"), "entity", "doc_id", either(F.lit("total"), F.coalesce(line["Id"], F.col("l.i").cast("string")))).alias("source_ref"),
        either(F.col("doc_number"), words).alias("__words"))
    entries = to_ledger(classify(lines, F.col("account"), F.col("__words"), F.col("__hint")))

    empty = (F.size("kept") == 0) & (F.col("occurred_on").isNull() | (F.coalesce("total", F.lit(0)) == 0))
    skipped = (
        known.where(unknown).select(F.lit("unknown_entity").alias("reason"), F.col("entity").alias("detail"))
        .unionByName(known.where(broken).select(F.lit("malformed_document").alias("reason"), F.col("entity").alias("detail")))
        .unionByName(head.where(empty).select(F.lit("no_dated_lines").alias("reason"), F.concat_ws(" ", "entity", "doc_id").alias("detail"))))
    return entries, skipped


_REF = "struct<value:string,name:string>"
FEED_DETAILS = {
    "SalesItemLineDetail": {"ItemRef": _REF, "AccountRef": _REF, "Qty": "string"},
    "ItemBasedExpenseLineDetail": {"ItemRef": _REF, "AccountRef": _REF, "Qty": "string"},
    "AccountBasedExpenseLineDetail": {"AccountRef": _REF},
    "JournalEntryLineDetail": {"AccountRef": _REF},
    "DepositLineDetail": {"AccountRef": _REF},
}
_DETAIL_FIELDS = ",".join(
    f"{kind}:struct<{','.join(f'{n}:{t}' for n, t in fields.items())}>" for kind, fields in FEED_DETAILS.items())
DOCUMENT_SCHEMA = (
    f"struct<Id:string,DocNumber:string,TxnDate:string,TotalAmt:string,CurrencyRef:{_REF},CustomerRef:{_REF},VendorRef:{_REF},"
    f"DepartmentRef:{_REF},Line:array<struct<Id:string,Amount:string,DetailType:string,Description:string,{_DETAIL_FIELDS}>>>"
)


# ---------------------------------------------------------------- posted lines


def account_direction(account_type: Column) -> Column:
    kind = F.lower(F.trim(account_type))
    return (
        F.when(kind.isin(*fv.INCOME_ACCOUNT_TYPES), "revenue").when(kind.isin(*fv.COGS_ACCOUNT_TYPES), "cogs")
        .when(kind.isin(*fv.EXPENSE_ACCOUNT_TYPES), "expense"))


def _label(pair: Column) -> Column:
    """The name in an ``[id, name]`` reference; empty when unset."""
    return F.coalesce(F.when(F.size(pair) >= 2, pair[1]), F.lit(""))


def entries_from_postings(lines: DataFrame, accounts: DataFrame, currency: str = "USD") -> tuple[DataFrame, DataFrame]:
    """Posted lines and the chart of accounts -> (entries, skipped); balance-sheet lines fall away."""
    chart = accounts.select(
        F.col("id").cast("long").alias("account_key"), F.col("name").alias("account_label"),
        account_direction(F.col("account_type")).alias("__hint")).where("__hint is not null")
    day = parse_iso_date(F.col("date"))
    skipped = lines.where(day.isNull()).select(F.lit("no_date").alias("reason"), F.col("id").cast("string").alias("detail"))
    dated = lines.where(day.isNotNull()).withColumns({
        "occurred_on": day, "account_key": F.when(F.size("account_id") >= 2, F.col("account_id")[0].try_cast("long"))})
    zero = F.lit(0).cast("decimal(18,2)")
    balance = F.coalesce(to_decimal(F.col("balance")), F.coalesce(to_decimal(F.col("debit")), zero) - F.coalesce(to_decimal(F.col("credit")), zero))
    kept = dated.join(chart, "account_key").withColumn("__balance", balance).where("__balance <> 0")
    code = F.upper(F.trim(_label(F.col("company_currency_id"))))
    shaped = kept.select(
        "occurred_on", "__hint",
        F.when(F.col("__hint") == "revenue", -F.col("__balance")).otherwise(F.col("__balance")).alias("amount"),
        F.coalesce(F.nullif(code, F.lit("")), F.lit(currency)).alias("currency"),
        F.coalesce(F.nullif(F.col("account_label"), F.lit("")), _label(F.col("account_id"))).alias("account"),
        F.coalesce("name", F.lit("")).alias("description"),
        _label(F.col("product_id")).alias("product"), _label(F.col("partner_id")).alias("counterparty"),
        _label(F.col("journal_id")).alias("location"), to_decimal(F.col("quantity"), 4).alias("quantity"),
        F.concat(F.lit("odoo:aml:"), F.col("id").cast("string")).alias("source_ref"), F.coalesce("name", F.lit("")).alias("__words"))
    return to_ledger(classify(shaped, F.col("account"), F.col("__words"), F.col("__hint"))), skipped


# ---------------------------------------------------------------- currency, merging, windows


def convert(entries: DataFrame, rates: DataFrame, base: str = "USD") -> DataFrame:
    """Adds ``amount_base`` = amount / rate; ``rates(currency, rate)``.  Unknown codes give null."""
    table = rates.where("rate <> 0").groupBy(F.upper("currency").alias("__code")).agg(F.min("rate").cast("decimal(18,6)").alias("__rate"))
    coded = entries.withColumn("__code", F.upper(F.coalesce(F.nullif(F.col("currency"), F.lit("")), F.lit(base))))
    joined = lookup(coded, table, ["__code"])
    value = F.when(F.col("__code") == base, F.col("amount").cast("decimal(38,10)")).otherwise(
        (F.col("amount").cast("decimal(24,8)") / F.col("__rate")).cast("decimal(38,10)"))
    return joined.select(*entries.columns, value.alias("amount_base"))


def require_rates(converted: DataFrame) -> None:
    """Refuse to report on amounts whose currency has no rate."""
    lost = [r[0] for r in converted.where("amount_base is null").select("currency").distinct().limit(20).collect()]
    if lost:
        raise LedgerError(f"no exchange rate configured for {', '.join(map(str, lost))}")


def merge_batches(batches: DataFrame, batch: str = "batch_no") -> DataFrame:
    """Newest batch wins per reference; entries without a reference always stay.

    Inside one batch a repeated reference keeps its greatest row, so reruns agree.
    """
    named = (F.col("source_ref").isNotNull()) & (F.col("source_ref") != "")
    columns = [c for c in batches.columns if c != "source_ref"]
    newest = batches.where(named).groupBy("source_ref").agg(
        F.max(F.struct(batch, *[c for c in columns if c != batch])).alias("e"))
    kept = newest.select("source_ref", "e.*").select(*batches.columns)
    return kept.unionByName(batches.where(~named))


def sync_window(runs: DataFrame, connections: DataFrame, today: Column, overlap: int = fv.SYNC_OVERLAP_DAYS,
                backfill: int = fv.SYNC_BACKFILL_DAYS) -> DataFrame:
    """Next window per connection: from the last success less the overlap, else a backfill."""
    ended = runs.where("status = 'succeeded' and window_end is not null").groupBy("connection_id").agg(
        F.max_by("window_end", "finished_at").alias("last_end"))
    joined = connections.join(ended, "connection_id", "left")
    start = F.when(F.col("last_end").isNotNull(), F.date_sub("last_end", overlap)).otherwise(F.date_sub(today, backfill))
    return joined.select("connection_id", start.alias("window_start"), today.alias("window_end"))


def batch_summary(entries: DataFrame, skipped: DataFrame) -> DataFrame:
    done = entries.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("classified_by") == "unmatched").alias("u"))
    parts = [
        done.select(F.lit("entries").alias("what"), F.col("n").alias("count")),
        done.select(F.lit("uncategorised").alias("what"), F.col("u").alias("count")),
        skipped.groupBy(F.concat(F.lit("skipped:"), "reason").alias("what")).agg(F.count(F.lit(1)).alias("count")),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_back(stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A stored ledger of any age: (entries, skipped). Missing columns are blank; every row is in one of the two.

    ``skipped`` has the stored columns and the ``reason`` why a row can't be read: no date, or no amount.
    """
    fixed = stored.withColumn("__stored", F.struct(*[F.col(f"`{c}`") for c in stored.columns]))
    if "occurred_on" in stored.columns:
        fixed = fixed.withColumn("occurred_on", parse_iso_date(F.col("occurred_on").cast("string")))
    full = to_ledger(fixed, "__stored")
    reason = F.when(F.col("occurred_on").isNull(), "no date").when(F.col("amount").isNull(), "no amount")
    skipped = full.withColumn("__reason", reason).where("__reason is not null").select(
        *[F.col(f"__stored.`{c}`").alias(c) for c in stored.columns if c != "reason"], F.col("__reason").alias("reason"))
    blanks = {"kind": "expense", "category": "other_expense", "currency": "USD", "classified_by": "matched"}
    blanks |= {c: "" for c in ("account", "description", "product", "location", "counterparty", "source_ref")}
    return full.where(reason.isNull()).drop("__stored").fillna(blanks), skipped
