"""Documents written from facts, in the layouts that ``records`` reads: what the extractors are held against at any scale.

Each function gives doc_id and text; even packages have the table layout, odd ones prose. Some documents contradict the facts on purpose,
by rules on the package number that the functions state.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(*parts) -> Column:
    """Lines that aren't null."""
    return F.concat_ws("\n", *parts)


def _work(pkg: str = "pkg") -> Column:
    return F.concat(F.col("category"), F.lit(" works Pkg-"), F.col(pkg))


def _ref() -> Column:
    return F.concat(F.lit("CC/"), F.col("client_key"), F.lit("/1996/"), F.col("pkg"))


def _lakh(value: Column) -> Column:
    return F.concat(F.lit("INR "), (value / 100000).cast("decimal(18,7)"), F.lit(" Lakh"))


def _row(label: str, value: Column) -> Column:
    return F.concat(F.lit(f"{label}    "), value)


def completion_certificates(works: DataFrame) -> DataFrame:
    """Certificates of works (with ``manager``, a name); those with pkg % 60 = 1 have no date."""
    date = F.when(F.col("pkg") % 60 != 1, F.col("completed"))
    head = F.concat("client_name", F.lit("  Office of the Chief Engineer"))
    place = F.concat(F.lit("Circle Office · "), "state", F.lit(" · IN"))
    graded = F.concat(F.lit("The work was graded "), "grading", F.lit("."))
    table = _lines(head, place, F.lit("COMPLETION CERTIFICATE"), F.concat(F.lit("Ref: "), _ref()), _row("Name of Work", _work()), _row("Nature / Category", F.col("category")), _row("Contract Value", _lakh(F.col("value"))), _row("Completion Date", F.date_format(date, "dd/MM/yyyy")), _row("Project Manager", F.col("manager")), graded)
    prose = F.concat_ws(
        " ",
        F.concat(F.lit("No. "), _ref(), F.lit(". This is to certify the work of “"), _work(), F.lit("” ("), F.col("category"), F.lit("), awarded earlier, with a gross executed value of Rs. "), F.col("value"), F.lit(" (Rupees as stated).")),
        F.concat(F.lit("It was completed in all respects on "), F.date_format(date, "d MMMM yyyy"), F.lit(".")),
        F.concat(F.lit("It was supervised on the contractor's side by "), F.col("manager"), F.lit(".")),
        graded,
    )
    text = F.when(F.col("pkg") % 2 == 0, table).otherwise(_lines(head, place, F.lit("CERTIFICATE OF COMPLETION"), prose))
    return works.select(F.concat(F.lit("cert-"), F.lpad(F.col("pkg").cast("string"), 12, "0")).alias("doc_id"), text.alias("text"))


def company_certificates(works: DataFrame) -> DataFrame:
    """The contractor's certificates; with pkg % 50 = 0 the value is one rupee more, with pkg % 70 = 0 there is no such package."""
    pkg = F.when(F.col("pkg") % 70 == 0, F.col("pkg") + 1_000_000_000_000).otherwise(F.col("pkg"))
    name = F.concat(F.col("category"), F.lit(" works Pkg-"), pkg)
    value = (F.col("value") + F.when(F.col("pkg") % 50 == 0, 1).otherwise(0)).cast("decimal(18,2)")
    client = F.concat(F.lit("Client "), "client_name", F.lit(" (government)"))
    who = F.coalesce("manager", F.lit("Vacant"))
    a = _lines(F.concat(F.lit("Work "), name), client, F.concat(F.lit("Client Certificate Ref "), _ref()), F.concat(F.lit("Executed Value INR "), value), F.lit("Completion as certified"), F.concat(F.lit("Project Lead "), who, F.lit(" Defect liability 12 months")))
    b = _lines(F.concat(F.lit("Project Name "), name), client, F.concat(F.lit("Reference "), _ref()), F.concat(F.lit("Contract Value Rs. "), value), F.lit("Completion as certified"), F.concat(F.lit("Project Lead "), who, F.lit(" Defect none")))
    return works.select(F.concat(F.lit("own-"), F.col("pkg")).alias("doc_id"), F.when(F.col("pkg") % 2 == 0, a).otherwise(b).alias("text"))


def portfolios(works: DataFrame) -> DataFrame:
    """A portfolio for each client, entries by package; with pkg % 30 = 0 the category is another one."""
    category = F.when(F.col("pkg") % 30 == 0, F.lit("Something Else")).otherwise(F.initcap("category"))
    role = F.when(F.col("role") == "JV Partner", "JV\nPartner").otherwise(F.col("role"))
    entry = _lines(
        F.concat(F.col("n"), F.lit(". "), _work()),
        F.concat(F.lit("   Client    "), "client_name", F.lit(" ("), role, F.lit(")")),
        F.concat(F.lit("   Category    "), category),
        F.concat(F.lit("   Executed Value    "), _lakh(F.col("value"))),
        F.concat(F.lit("   Completed    "), F.date_format("completed", "MMM d, yyyy"), F.lit(" · Certificate "), _ref()),
    )
    numbered = works.withColumn("n", F.col("pkg") % 90 + 1)
    each = numbered.select("client_key", "pkg", entry.alias("entry")).groupBy("client_key").agg(F.array_sort(F.collect_list(F.struct("pkg", "entry"))).alias("entries"))
    return each.select(F.concat(F.lit("ppp-"), F.col("client_key")).alias("doc_id"), F.concat(F.lit("PAST PERFORMANCE\n"), F.array_join(F.transform("entries", lambda e: e["entry"]), "\n")).alias("text"))


def reference_letters(works: DataFrame) -> DataFrame:
    """Letters of the works that have one; with pkg % 40 = 0 the role is Prime whatever it was."""
    role = F.when(F.col("pkg") % 40 == 0, "Prime").otherwise(F.col("role"))
    a = _lines(F.concat("client_name", F.lit("  Office of the Secretary")), F.concat(F.lit("Project Name "), _work(), F.lit(" Scope of Work as built")), F.concat(F.lit("Contractor's Role "), role))
    b = _lines(F.col("client_name"), F.lit(""), F.concat(F.lit("Subject: reference for “"), _work(), F.lit("”")), F.concat(F.lit("Contractor's Role "), role, F.lit(" throughout.")))
    return works.where("has_ref").select(F.concat(F.lit("ref-"), F.col("pkg")).alias("doc_id"), F.when(F.col("pkg") % 2 == 0, a).otherwise(b).alias("text"))


def _employee() -> Column:
    return F.concat(F.lit("EMP-"), F.col("manager_key"))


def personnel_certificates(people: DataFrame) -> DataFrame:
    """Certificates of managers (manager_key, name, credential, credential_id, issued), by the employer (even keys) or the issuing body."""
    a = _lines(F.concat(F.lit("This is to certify that "), "name"), F.concat(F.lit("Employee ID: "), _employee()), F.concat(F.lit("Credential Type "), "credential"), F.concat(F.lit("Credential ID "), "credential_id"), F.concat(F.lit("Date of Issue "), F.date_format("issued", "dd/MM/yyyy")))
    b = _lines(F.lit("The board has conferred upon"), F.concat(F.col("name"), F.lit(" of Head Office ("), _employee(), F.lit(")")), F.concat(F.lit("Certification Body "), "credential"), F.lit("This credential stands."), F.concat(F.lit("Certificate No. "), "credential_id"), F.concat(F.lit("Issued "), F.date_format("issued", "d MMM yyyy")))
    return people.select(F.concat(F.lit("per-"), F.col("manager_key")).alias("doc_id"), F.when(F.col("manager_key") % 2 == 0, a).otherwise(b).alias("text"))


def cvs(people: DataFrame) -> DataFrame:
    """CVs of managers (manager_key, name, business_unit, issued)."""
    years = (F.col("manager_key") % 30).cast("string")
    text = _lines(F.concat(F.lit("Name "), "name"), F.concat(F.lit("Employee ID "), _employee()), F.lit("Designation Project Manager"), F.concat(F.lit("Business Unit "), "business_unit"), F.concat(F.lit("Total Experience "), years, F.lit(" years")), F.concat(F.lit("Date of Joining "), F.date_format("issued", "yyyy-MM-dd")))
    return people.select(F.concat(F.lit("cv-"), F.col("manager_key")).alias("doc_id"), text.alias("text"))


def performance_bonds(works: DataFrame) -> DataFrame:
    tender = F.concat(F.lit("RFP-"), F.col("pkg"))
    a = _lines(F.lit("Bank of the Circle"), F.lit(""), F.concat(F.lit("Bond No: B"), "pkg"), F.concat(F.lit("Date: "), F.date_format("completed", "yyyy-MM-dd")), F.concat(F.lit("Tender "), tender), F.concat(F.lit("an amount not exceeding Rs. "), "value", F.lit(" (Rupees as stated) for the work of "), _work(), F.lit(", and no more")))
    b = _lines(F.lit("Bank of the Circle · Main Branch"), F.lit(""), F.concat(F.lit("BG No: B"), "pkg"), F.concat(F.lit("Issue Date "), F.date_format("completed", "MMMM d, yyyy")), F.concat(F.lit("Subject: Performance Bond — "), _work(), F.lit(" (Tender "), tender, F.lit(")")), F.concat(F.lit("for a sum of Rs. "), "value", F.lit(" (Rupees as stated)")))
    return works.select(F.concat(F.lit("bond-"), F.col("pkg")).alias("doc_id"), F.when(F.col("pkg") % 2 == 0, a).otherwise(b).alias("text"))


def tender_dossiers(works: DataFrame) -> DataFrame:
    tender = F.concat(F.lit("RFP-"), F.col("pkg"))
    client = F.concat(F.lit("The Tender Inviting Authority, "), "client_name", F.lit(" Dear Sir"))
    a = _lines(tender, client, F.concat(F.lit("Bid value: "), _lakh(F.col("value"))), F.concat(F.lit("Submitted: "), F.date_format("completed", "dd/MM/yyyy")))
    b = _lines(client, F.concat(F.lit("re "), tender), F.concat(F.lit("Our offer is Rs. "), "value", F.lit(", all in")), F.concat(F.lit("Submitted: "), F.date_format("completed", "d MMM yyyy")))
    return works.select(F.concat(F.lit("bid-"), F.col("pkg")).alias("doc_id"), F.when(F.col("pkg") % 2 == 0, a).otherwise(b).alias("text"))


def ageing_books(works: DataFrame) -> DataFrame:
    """A workbook for each client: doc_id and sheets, a row for each work; no outstanding column for odd clients."""
    paid = (F.col("value") - 1).cast("decimal(18,2)").cast("string")
    row = F.array(F.col("client_name"), F.concat(F.lit("INV-"), "pkg"), F.date_format("completed", "yyyy-MM-dd"), F.col("value").cast("string"), paid, F.lit("1.00"))
    head = F.array(*(F.lit(x) for x in ("Party name", "Invoice  No", "Invoice date", "Billed (INR)", "Collected", "Balance")))
    books = works.select("client_key", "pkg", row.alias("row")).groupBy("client_key").agg(F.array_sort(F.collect_list(F.struct("pkg", "row"))).alias("rows"))
    width = F.when(F.col("client_key") % 2 == 0, 6).otherwise(5)
    rows = F.transform(F.concat(F.array(head), F.transform("rows", lambda r: r["row"])), lambda r: F.slice(r, 1, width))
    sheet = F.struct(F.lit("Ageing").alias("sheet"), rows.alias("rows"))
    return books.select(F.concat(F.lit("ar-"), F.col("client_key")).alias("doc_id"), F.array(sheet).alias("sheets"))


# ------------------------------------------------------------------------------------------- a whole estate
OURS = "Setu Infra Limited"
_SHEETS = "array<struct<sheet:string, rows:array<array<string>>>>"
#: Kinds that give no records: (type, text); the second ra bill says more than the first, as the report does of the statement.
OTHERS = [
    ("compliance_matrix", "Annexure 3\nCompliance Checklist\nItem Met"),
    ("general_ledger_book", "Books of account\nDebit Credit"),
    ("bank_statement", "Statement of Account\nA/C: 1100"),
    ("financial_statement", "Balance Sheet as at March"),
    ("ra_bill", "Running Account Bill no. 2"),
    ("final_ra_bill", "Final RA Bill\na running account bill, with measurements"),
    ("iso_certificate", "Certificate of Registration\nby an accredited certification body"),
    ("annual_report", "Annual Report\nwith the balance sheet and the statement of profit and loss"),
    ("unknown", "Minutes of a meeting\nNothing was decided."),
]


def estate(works: DataFrame, people: DataFrame) -> DataFrame:
    """doc_id, truth, text, sheets, error: documents of all kinds in one table.

    Two thirds of the contractor's certificates say no more than the clients' do: only the letterhead tells them apart. Every tenth client has a
    bill of quantities beside its ageing book, every fiftieth a file that can't be read.
    """
    ours = F.lit(f"{OURS}  Projects Division")
    pkg = F.regexp_extract("doc_id", r"(\d+)$", 1).try_cast("bigint")
    own = F.when(pkg % 3 == 0, "RECORD OF WORK COMPLETED").otherwise("Completion Certificate")
    letter = F.when(pkg % 2 == 0, "LETTER OF RECOMMENDATION").otherwise("To whomsoever it may concern")
    texts = [
        ("completion_certificate", completion_certificates(works), lambda t: t),
        ("company_completion_certificate", company_certificates(works), lambda t: _lines(ours, t, own)),
        ("past_performance_portfolio", portfolios(works), lambda t: _lines(ours, F.lit("Portfolio of Completed Works"), t)),
        ("reference_letter", reference_letters(works), lambda t: _lines(t, letter)),
        ("performance_bond", performance_bonds(works), lambda t: _lines(t, F.lit("PERFORMANCE BANK GUARANTEE"))),
        ("tender_dossier", tender_dossiers(works), lambda t: _lines(ours, t, F.lit("Tender Submission Dossier"))),
        ("personnel_certificate", personnel_certificates(people), lambda t: t),
        ("cv", cvs(people), lambda t: _lines(t, F.lit("Curriculum Vitae"))),
    ]
    none = F.lit(None).cast("string")
    parts = [d.select("doc_id", F.lit(kind).alias("truth"), make(F.col("text")).alias("text"), F.lit(None).cast(_SHEETS).alias("sheets"), none.alias("error")) for kind, d, make in texts]
    others = people.select("manager_key", F.explode(F.array(*[F.struct(F.lit(k).alias("truth"), F.lit(t).alias("text")) for k, t in OTHERS])).alias("o"))
    parts.append(others.select(F.concat_ws("-", F.lit("oth"), "manager_key", "o.truth").alias("doc_id"), "o.truth", "o.text", F.lit(None).cast(_SHEETS).alias("sheets"), none.alias("error")))
    head = F.array(*(F.lit(x) for x in ("Client", "Invoice No", "Invoice date", "Invoiced", "Collected", "Outstanding")))
    cover = F.struct(F.lit("Cover").alias("sheet"), F.array(F.array(F.lit("Prepared by accounts"))).alias("rows"))

    def headed(sheet: Column) -> Column:
        rows = sheet["rows"]
        first = F.array(F.slice(head, 1, F.size(F.get(rows, F.lit(0)))))
        return F.struct(sheet["sheet"].alias("sheet"), F.concat(first, F.slice(rows, 2, F.size(rows))).alias("rows"))

    books = ageing_books(works).select("doc_id", F.lit("ageing_workbook").alias("truth"), none.alias("text"), F.concat(F.array(cover), F.transform("sheets", headed)).cast(_SHEETS).alias("sheets"), none.alias("error"))
    clients = works.select("client_key").distinct()
    bill = F.array(F.struct(F.lit("Works").alias("sheet"), F.array(F.array(F.lit("Item No"), F.lit("Rate")), F.array(F.lit("1"), F.lit("12"))).alias("rows")))
    boq = clients.where("client_key % 10 = 0").select(F.concat(F.lit("boq-"), "client_key").alias("doc_id"), F.lit("boq_workbook").alias("truth"), none.alias("text"), bill.cast(_SHEETS).alias("sheets"), none.alias("error"))
    bad = clients.where("client_key % 50 = 0").select(F.concat(F.lit("bad-"), "client_key").alias("doc_id"), F.lit("unreadable").alias("truth"), none.alias("text"), F.lit(None).cast(_SHEETS).alias("sheets"), F.lit("BadZipFile: File is not a zip file").alias("error"))
    out = parts[0]
    for part in [*parts[1:], books, boq, bad]:
        out = out.unionByName(part)
    return out
