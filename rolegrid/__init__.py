"""Job-posting and crawl analytics as Spark DataFrame operators.

Every operator takes DataFrames (and column names) and returns DataFrames; Spark decides the
physical plan. ``functions`` holds Column expressions, ``operators`` relational operators,
``sources`` readers and writers, ``plans`` the composed jobs, ``streaming`` the continuous twins,
and ``catalog`` the queries registered for the driver tables.
"""
