"""Stock-count analytics over fleets of spoken and typed inventory utterances.

Every public function takes DataFrames (or Columns) and returns DataFrames (or
Columns); nothing is collected and nothing runs in a Python row loop.
"""
