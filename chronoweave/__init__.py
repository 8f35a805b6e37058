"""Text-to-context analytics on Spark DataFrames.

Feeds and pages go in; scored time spans, places, people, keyphrases, clusters, facets and
search indexes come out.  Every public function takes and returns DataFrames or Columns.
"""
