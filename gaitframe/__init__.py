"""Motion analytics of body-pose landmarks, as Spark DataFrame programs."""
