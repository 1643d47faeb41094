import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from cohortlens.session import local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def people(spark):
    """100 employees; every fifth one leaves."""
    rows = []
    for i in range(100):
        leave = i % 5 == 0
        rows.append((
            i + 1, 22 + i % 30, "Sales" if i % 2 == 0 else "Research & Development",
            "Yes" if leave or i % 3 == 0 else "No", 3000 + 40 * i, 1 + i % 10, 1 if leave else 3 + i % 2,
            "Yes" if leave else "No",
        ))
    return spark.createDataFrame(
        rows, "EmployeeNumber bigint, Age int, Department string, OverTime string, MonthlyIncome int, "
              "YearsAtCompany int, JobSatisfaction int, Attrition string")
