"""Operations on training text: ten operators and their registered queries.

Nothing outside this folder imports it.  ``registry`` lists the queries.
"""
