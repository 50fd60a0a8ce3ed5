"""Role taxonomies: a nested JSON document, flattened to ordered rows.

Any taxonomy with the shape {version, families[{family, roles[{canonical,
aliases[]}]}], seniorityPrefixes[], genericRejects[]} can be passed in; read_taxonomy
reads one from a file. The default follows occupation titles of the public
International Standard Classification of Occupations (ISCO-08), with everyday other names.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import values as V

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("version", T.StringType()),
    T.StructField("families", T.ArrayType(T.StructType([
        T.StructField("family", T.StringType()),
        T.StructField("roles", T.ArrayType(T.StructType([
            T.StructField("canonical", T.StringType()),
            T.StructField("aliases", T.ArrayType(T.StringType())),
        ]))),
    ]))),
    T.StructField("seniorityPrefixes", T.ArrayType(T.StringType())),
    T.StructField("genericRejects", T.ArrayType(T.StringType())),
])

# Group of occupations -> title -> other names.
OCCUPATIONS: dict[str, dict[str, list[str]]] = {
    "Science and Engineering": {
        "Civil Engineer": ["Construction Engineer", "Highway Engineer"],
        "Mechanical Engineer": ["Machine Design Engineer"],
        "Electrical Engineer": ["Power Systems Engineer"],
        "Chemical Engineer": ["Process Engineer"],
        "Architect": ["Building Architect", "Landscape Architect"],
        "Surveyor": ["Land Surveyor", "Cartographer"],
        "Statistician": ["Actuary", "Biostatistician"],
    },
    "Information and Communications Technology": {
        "Systems Analyst": ["Computer Systems Analyst", "Information Systems Analyst"],
        "Software Developer": ["Software Engineer", "Software Programmer"],
        "Web Developer": ["Website Developer", "Multimedia Developer"],
        "Applications Programmer": ["C++ Programmer", "Computer Programmer"],
        "Database Administrator": ["DBA", "Database Designer"],
        "Network Engineer": ["Computer Network Engineer", "Network Technician"],
        "Data Analyst": ["Data Specialist", "Data Scientist"],
    },
    "Business and Administration": {
        "Accountant": ["Chartered Accountant", "Auditor"],
        "Investment Adviser": ["Financial Planner", "Estate Planner"],
        "Management Consultant": ["Organisation Analyst"],
        "Personnel Officer": ["Staffing Officer", "Careers Adviser"],
        "Public Relations Officer": ["PR", "Press Officer"],
        "Marketing Specialist": ["Advertising Specialist", "Market Researcher"],
        "Sales Representative": ["Medical Sales Representative", "Commercial Traveller"],
        "Buyer": ["Purchasing Officer", "Procurement Officer"],
        "Executive Secretary": ["Administrative Secretary"],
    },
    "Health": {
        "Nurse": ["Registered Nurse", "Staff Nurse", "RN"],
        "Midwife": [],
        "Pharmacist": ["Dispensing Chemist"],
        "Physiotherapist": ["Physical Therapist"],
        "Dentist": ["Dental Surgeon"],
        "Laboratory Technician": ["Medical Laboratory Technician"],
    },
    "Teaching": {
        "Secondary School Teacher": ["High School Teacher"],
        "Primary School Teacher": ["Elementary School Teacher"],
        "University Lecturer": ["College Lecturer"],
    },
    "Law, Social and Culture": {
        "Lawyer": ["Barrister", "Solicitor"],
        "Librarian": ["Archivist"],
        "Journalist": ["News Reporter"],
        "Translator": ["Interpreter", "Translator/Interpreter"],
        "Graphic Designer": ["Multimedia Designer"],
        "Social Worker": ["Family Counsellor"],
    },
    "Services and Trades": {
        "Chef": ["Head Cook"],
        "Shop Assistant": ["Shop Sales Assistant"],
        "Contact Centre Clerk": ["Call Centre Agent"],
        "Electrician": ["Building Electrician"],
        "Plumber": ["Pipe Fitter"],
        "Welder": ["Flame Cutter"],
        "Truck Driver": ["Lorry Driver"],
    },
}


@dataclass(frozen=True)
class RoleSurface:
    family: str
    canonical: str
    surface: str
    kind: str  # canonical | alias
    role_ord: int
    ord: int


@dataclass
class Taxonomy:
    version: str
    families: list
    seniority: list = field(default_factory=list)
    generics: list = field(default_factory=list)

    @classmethod
    def from_json(cls, text: str) -> "Taxonomy":
        d = json.loads(text)
        return cls(d["version"], d.get("families", []), d.get("seniorityPrefixes", []), d.get("genericRejects", []))

    def to_json(self) -> str:
        return json.dumps({"version": self.version, "families": self.families, "seniorityPrefixes": self.seniority, "genericRejects": self.generics})

    def surfaces(self) -> list[RoleSurface]:
        pairs = [(fam["family"], role) for fam in self.families for role in fam["roles"]]
        named = [
            (family, role["canonical"], surface, "alias" if i else "canonical", r)
            for r, (family, role) in enumerate(pairs)
            for i, surface in enumerate([role["canonical"], *role.get("aliases", [])])
        ]
        return [RoleSurface(*n, ord=k) for k, n in enumerate(named)]


def built_in() -> Taxonomy:
    families = [{"family": f, "roles": [{"canonical": c, "aliases": names} for c, names in roles.items()]} for f, roles in OCCUPATIONS.items()]
    return Taxonomy("1.0.0", families, V.SENIORITY_PREFIXES, V.GENERIC_TITLES)


def read_taxonomy(spark: SparkSession, path: str) -> Taxonomy:
    """A taxonomy file is one small document in any store Spark reads; it is read once where the plan is built."""
    return Taxonomy.from_json(spark.read.text(path, wholetext=True).first()[0])


SURFACE_SCHEMA = "family string, canonical string, surface string, kind string, role_ord int, ord int"


def local_frame(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table known where the plan is built. Through Arrow it becomes a local relation,
    so projections over it are folded by the optimizer instead of running as a job."""
    names = [f.split()[0] for f in schema.split(",")]
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    types = [kinds[f.split()[1]] for f in schema.split(",")]
    return spark.createDataFrame(pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names))


def surface_frame(spark: SparkSession, tax: Taxonomy) -> DataFrame:
    rows = [(s.family, s.canonical, s.surface, s.kind, s.role_ord, s.ord) for s in tax.surfaces()]
    return local_frame(spark, rows, SURFACE_SCHEMA)


def flatten_taxonomies(docs: DataFrame, id_col: str, json_col: str = "value") -> DataFrame:
    """One row per surface form of every taxonomy document, in document order."""
    t = docs.select(id_col, F.from_json(json_col, TAXONOMY_SCHEMA).alias("t"))
    fam = t.select(id_col, F.posexplode("t.families").alias("family_no", "f"))
    role = fam.select(id_col, "family_no", F.col("f.family").alias("family"), F.posexplode("f.roles").alias("role_no", "r"))
    names = F.concat(F.array(F.col("r.canonical")), F.coalesce(F.col("r.aliases"), F.array().cast("array<string>")))
    return role.select(
        id_col, "family_no", "role_no", "family", F.col("r.canonical").alias("canonical"), F.posexplode(names).alias("name_no", "surface")
    ).withColumn("kind", F.when(F.col("name_no") == 0, "canonical").otherwise("alias"))
