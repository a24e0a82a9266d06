"""The three query shapes, assembled from operators, and their registered queries."""
