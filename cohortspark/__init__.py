"""cohortspark: questionnaire-study analytics and data preparation on Spark."""
