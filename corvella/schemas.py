"""Rows of e-mail events."""

EMAIL = "struct<id:string, subject:string, from_address:struct<emailAddress:struct<address:string>>, received_date_time:string, body:struct<content:string>, is_read:boolean, has_attachments:boolean, importance:string, keywords:array<string>, attachments:array<struct<id:string,name:string,contentType:string,size:long,contentLocation:string>>>"
EMAIL_EVENT = f"event_id string, account_id string, occurred_at string, response_data struct<value:array<{EMAIL}>>"
