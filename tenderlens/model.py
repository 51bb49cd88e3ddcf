"""Explicit schemas: the nested release document and the flat staging tables."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame

from tenderlens.rules import Rules

MONEY = "decimal(30,4)"

_VALUE = f"struct<amount:{MONEY},currency:string>"
_PARTY_REF = "struct<id:string,name:string>"
_MILESTONE = (
    "struct<id:string,title:string,description:string,code:string,"
    "dueDate:string,dateMet:string,status:string>"
)
_BUDGET = (
    "struct<id:string,projectID:string,project:string,description:string,"
    f"amount:{_VALUE}>"
)
_TENDER = (
    "struct<id:string,title:string,description:string,status:string,"
    "procurementMethod:string,procurementMethodDetails:string,"
    f"procurementMethodRationale:string,numberOfTenderers:int,value:{_VALUE},"
    "tenderPeriod:struct<startDate:string,endDate:string>,"
    "awardPeriod:struct<endDate:string>,awardCriteria:string,"
    "awardCriteriaDetails:string,hasEnquiries:boolean,"
    "submissionMethod:array<string>,submissionMethodDetails:string>"
)
_AWARD = (
    "struct<id:string,title:string,description:string,status:string,date:string,"
    f"value:{_VALUE},suppliers:array<{_PARTY_REF}>>"
)
_TRANSACTION = f"struct<id:string,value:{_VALUE},payer:{_PARTY_REF},payee:{_PARTY_REF}>"
_CONTRACT = (
    "struct<id:string,awardID:string,title:string,description:string,status:string,"
    f"value:{_VALUE},dateSigned:string,period:struct<startDate:string,endDate:string>,"
    f"milestones:array<{_MILESTONE}>,implementation:struct<"
    f"transactions:array<{_TRANSACTION}>,milestones:array<{_MILESTONE}>>>"
)
MILESTONES, TRANSACTIONS = f"array<{_MILESTONE}>", f"array<{_TRANSACTION}>"
_PARTY = (
    "struct<id:string,name:string,identifier:struct<scheme:string,id:string>,"
    "roles:array<string>>"
)

RELEASE_FIELDS = {
    "id": "string",
    "ocid": "string",
    "date": "string",
    "tag": "array<string>",
    "initiationType": "string",
    "language": "string",
    "buyer": _PARTY_REF,
    "parties": f"array<{_PARTY}>",
    "planning": f"struct<budget:{_BUDGET}>",
    "tender": _TENDER,
    "awards": f"array<{_AWARD}>",
    "contracts": f"array<{_CONTRACT}>",
}
RELEASE_SCHEMA = ", ".join(f"`{k}` {v}" for k, v in RELEASE_FIELDS.items())
RELEASE_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in RELEASE_FIELDS.items()) + ">"
PACKAGE_SCHEMA = (
    "uri string, version string, publishedDate string, "
    "publisher struct<name:string,scheme:string,uid:string>, license string, "
    f"publicationPolicy string, releases array<{RELEASE_STRUCT}>"
)


@dataclass(frozen=True)
class Staging:
    """The nine flat tables. Section tables also carry ``ocid`` and
    ``release_seq`` of their release, so latest-per-key never has to join
    back to the releases table."""

    releases: DataFrame
    planning: DataFrame
    tender: DataFrame
    awards: DataFrame
    award_suppliers: DataFrame
    contracts: DataFrame
    transactions: DataFrame
    milestones: DataFrame
    parties: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self)}


@dataclass(frozen=True)
class Core:
    """Staging plus the materialised dimensions and latest-per-key tables."""

    stg: Staging
    dim_buyer: DataFrame
    dim_supplier: DataFrame
    budget_lines: DataFrame
    process_snapshot: DataFrame
    process_sections: DataFrame
    rules: Rules
