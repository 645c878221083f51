"""Network threat analytics as Spark jobs: events -> detections -> alerts -> incidents."""
