"""Operators for preparing large text corpora for training.

Nothing else in the library imports this subpackage, and it imports nothing from the rest of the library.
Every operator takes a DataFrame and column names and returns a DataFrame; `queries` holds the registered queries.

Conventions shared by all operators:

* a null text counts as an empty text unless the operator's docstring says otherwise;
* a null id is an ordinary id; rows that repeat an id are separate rows unless the operator's docstring says otherwise;
* operators read only the columns they name, so extra columns cannot clash with their own;
* an empty table gives an empty result with the same schema.
"""
