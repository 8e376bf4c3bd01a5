"""riskspark: fraud-risk scoring of social-media posts as DataFrame operators."""
