"""Licence notices wrapped as in source headers and licence files."""

from tallyhouse.llm import licenses

HEADERS = {
    "GPL": """// This program is free software: you can redistribute it and/or modify
// it under the terms of the GNU General Public License as published by
// the Free Software Foundation, either version 3 of the License, or
// (at your option) any later version.
//
int main() { return 0; }""",
    "LGPL": """/*
 * This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version.
 */""",
    "BSD": """# Redistribution and use in source and binary forms, with or without
# modification, are permitted provided that the following conditions
# are met:
#
# 1. Redistributions of source code must retain the above notice.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy\r
of this software and associated documentation files (the "Software"), to deal\r
in the Software without restriction.\r
\r
Another paragraph.""",
}


def test_wrapped_notices(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = licenses.train(documents)
    docs = spark.createDataFrame(list(HEADERS.items()), "doc_id string, text string")
    found = {r.doc_id: (r.families, r.n_license) for r in licenses.scan(docs, model).collect()}
    assert found == {family: (family, 1) for family in HEADERS}
