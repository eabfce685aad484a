"""Layer schemas and the fixed values that results depend on."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

RAW_POSTINGS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("job_platform_id", T.StringType(), False),
        T.StructField("search_role", T.StringType(), False),
        T.StructField("country_code", T.StringType(), False),
        T.StructField("raw_data", T.StringType(), False),
        T.StructField("extracted_at", T.TimestampNTZType(), False),
        T.StructField("extraction_batch_id", T.StringType(), False),
    ]
)

STG_JOBS = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("job_platform_id", T.StringType(), False),
        T.StructField("search_role", T.StringType(), False),
        T.StructField("country_code", T.StringType(), False),
        T.StructField("title", T.StringType()),
        T.StructField("company_name", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("location_display", T.StringType()),
        T.StructField("location_areas", T.ArrayType(T.StringType())),
        T.StructField("category_tag", T.StringType()),
        T.StructField("category_label", T.StringType()),
        T.StructField("salary_min", MONEY),
        T.StructField("salary_max", MONEY),
        T.StructField("salary_is_predicted", T.BooleanType()),
        T.StructField("salary_currency", T.StringType()),
        T.StructField("contract_type", T.StringType()),
        T.StructField("contract_time", T.StringType()),
        T.StructField("redirect_url", T.StringType()),
        T.StructField("job_posted_at", T.TimestampNTZType()),
        T.StructField("extracted_at", T.TimestampNTZType()),
        T.StructField("processed_at", T.TimestampNTZType()),
        T.StructField("raw_job_id", T.LongType()),
    ]
)

STG_JOB_SKILLS = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("skill_id", T.LongType(), False),
        T.StructField("skill_name", T.StringType(), False),
        T.StructField("mention_count", T.LongType()),
        T.StructField("extracted_at", T.TimestampNTZType()),
    ]
)

DIM_SKILLS = T.StructType(
    [
        T.StructField("skill_id", T.LongType(), False),
        T.StructField("skill_name", T.StringType(), False),
        T.StructField("skill_category", T.StringType()),
        T.StructField("skill_subcategory", T.StringType()),
    ]
)

TAXONOMY = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("category", T.StringType()),
        T.StructField("subcategory", T.StringType()),
        T.StructField("aliases", T.ArrayType(T.StringType())),
    ]
)

CANDIDATES = T.StructType(
    [
        T.StructField("job_id", T.LongType(), False),
        T.StructField("position", T.IntegerType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("label", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)

# ---------------------------------------------------------------------------------------------
# Fixed values. Results must equal those of existing deployments, so these lists are given as data.
# ---------------------------------------------------------------------------------------------

# role -> role category
ROLES = {
    "Data Engineer": "Data",
    "Analytics Engineer": "Data",
    "Data Scientist": "Data",
    "Data Analyst": "Data",
    "Business Intelligence Developer": "Data",
    "Machine Learning Engineer": "AI/ML",
    "AI Engineer": "AI/ML",
    "Computer Vision Engineer": "AI/ML",
    "Backend Developer": "Engineering",
    "Frontend Developer": "Engineering",
    "Full Stack Developer": "Engineering",
    "Mobile Developer": "Engineering",
    "DevOps Engineer": "Operations",
    "Cloud Architect": "Operations",
    "Cyber Security Engineer": "Security",
}

# country code -> (country name, currency)
COUNTRIES = {
    "gb": ("United Kingdom", "GBP"),
    "us": ("United States", "USD"),
    "au": ("Australia", "AUD"),
    "at": ("Austria", "EUR"),
    "be": ("Belgium", "EUR"),
    "br": ("Brazil", "BRL"),
    "ca": ("Canada", "CAD"),
    "de": ("Germany", "EUR"),
    "fr": ("France", "EUR"),
    "in": ("India", "INR"),
    "it": ("Italy", "EUR"),
    "mx": ("Mexico", "MXN"),
    "nl": ("Netherlands", "EUR"),
    "nz": ("New Zealand", "NZD"),
    "pl": ("Poland", "PLN"),
    "ru": ("Russia", "RUB"),
    "sg": ("Singapore", "SGD"),
    "za": ("South Africa", "ZAR"),
}
DEFAULT_CURRENCY = "USD"

# candidate label -> skill category; any other label is 'Other'
LABEL_CATEGORIES = {
    "programming language": "Programming Language",
    "database": "Database",
    "cloud platform": "Cloud Platform",
    "cloud service": "Cloud Platform",
    "big data tool": "Big Data",
    "data engineering tool": "Data Engineering",
    "machine learning framework": "Machine Learning",
    "devops tool": "DevOps",
    "web framework": "Web Framework",
    "frontend framework": "Web Framework",
    "backend framework": "Web Framework",
    "data visualization tool": "Data Visualization",
    "version control": "Version Control",
    "api technology": "API & Integration",
    "testing framework": "Testing",
    "security tool": "Security",
    "operating system": "Operating System",
    "containerization tool": "DevOps",
    "orchestration tool": "DevOps",
    "message queue": "Big Data",
    "data warehouse": "Database",
    "etl tool": "Data Engineering",
    "bi tool": "Data Visualization",
    "monitoring tool": "DevOps",
    "ci cd tool": "DevOps",
}

# words too general to be a skill
GENERIC_WORDS = (
    "software technology data system systems application applications tool tools platform service services "
    "solution solutions product products framework frameworks library libraries code coding programming "
    "development engineering analysis analytics database databases cloud api apis web mobile backend frontend "
    "server servers client clients user users project projects team teams experience skills skill knowledge "
    "expertise ability"
).split()


def local_table(spark: SparkSession, **columns: list) -> DataFrame:
    """A few fixed rows as a local relation, whose size Catalyst knows."""
    return spark.createDataFrame(pa.table(columns))


def roles(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        role_id=pa.array(range(1, len(ROLES) + 1), pa.int64()),
        role_name=list(ROLES),
        role_category=list(ROLES.values()),
        is_active=[True] * len(ROLES),
    )


def countries(spark: SparkSession) -> DataFrame:
    return local_table(
        spark,
        country_code=list(COUNTRIES),
        country_name=[name for name, _ in COUNTRIES.values()],
        is_active=[True] * len(COUNTRIES),
    )


def label_categories(spark: SparkSession) -> DataFrame:
    return local_table(spark, label=list(LABEL_CATEGORIES), category=list(LABEL_CATEGORIES.values()))


def generic_words(spark: SparkSession) -> DataFrame:
    return local_table(spark, word=list(GENERIC_WORDS))
