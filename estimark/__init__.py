"""estimark: team estimation sessions (rooms, tasks, votes, medians) as Spark jobs.

Every operator takes DataFrames and returns a DataFrame; nothing is collected
to the driver.  ``estimark.plans.catalog`` wires the operators to the test
tables for the driver's ``queries()`` / ``oracle_sql()`` contract.
"""

from estimark.session import get_session, checkpoint_dir  # noqa: F401
